"""Columns over operation lists: ops_json text such as [["link", 1, 11, null], ["exit", 2, null, null]]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An operation as a struct; dst1 and dst2 are NULL where the kind has none.
OP = "struct<kind:string,src:int,dst1:int,dst2:int>"
#: Destinations that a kind must have.
ARITY = {"link": 1, "divide": 2, "exit": 0}


def parse(ops_json: Column | str) -> Column:
    """Text to an array of operations; text that is no such list gives NULL."""
    raw = F.from_json(ops_json, "array<array<string>>")

    def op(x: Column) -> Column:
        return F.struct(F.get(x, F.lit(0)).alias("kind"), F.get(x, F.lit(1)).try_cast("int").alias("src"), F.get(x, F.lit(2)).try_cast("int").alias("dst1"), F.get(x, F.lit(3)).try_cast("int").alias("dst2"))

    return F.transform(raw, op)


def format_ops(ops: Column) -> Column:
    """An array of operations to its text, NULL as null."""
    def one(x: Column) -> Column:
        numbers = [F.coalesce(x[c].cast("string"), F.lit("null")) for c in ("src", "dst1", "dst2")]
        return F.concat(F.lit('["'), x["kind"], F.lit('", '), F.concat_ws(", ", *numbers), F.lit("]"))

    return F.concat(F.lit("["), F.array_join(F.transform(ops, one), ", "), F.lit("]"))


def canonical(ops: Column) -> Column:
    """A key that is equal for lists that differ in order, or in the order of daughters, only."""
    def one(x: Column) -> Column:
        d1, d2 = F.coalesce(x["dst1"], F.lit(-1)), F.coalesce(x["dst2"], F.lit(-1))
        swap = (x["kind"] == "divide") & (d1 > d2)
        return F.struct(x["src"].alias("src"), x["kind"].alias("kind"), F.when(swap, d2).otherwise(d1).alias("d1"), F.when(swap, d1).otherwise(d2).alias("d2"))

    def text(x: Column) -> Column:
        return F.concat_ws(":", x["src"].cast("string"), x["kind"], x["d1"].cast("string"), x["d2"].cast("string"))

    return F.array_join(F.transform(F.array_sort(F.transform(ops, one)), text), "|")


def count(ops: Column, kind: str) -> Column:
    return F.size(F.filter(ops, lambda x: x["kind"] == kind))


def compact(ops: Column) -> Column:
    """First letters from the closed end to the open end."""
    return F.array_join(F.reverse(F.transform(ops, lambda x: F.substring(x["kind"], 1, 1))), "")


def from_compact(text: Column) -> Column:
    """Kinds of a compact sequence, in open-first order: letters l, d, e or words, apart by anything; else NULL."""
    cleaned = F.lower(text)
    for word in ("divide", "link", "exit"):
        cleaned = F.regexp_replace(cleaned, word, word[0])
    letters = F.regexp_replace(cleaned, r"[\s,;\[\]()'\"-]+", "")
    kinds = F.transform(F.reverse(F.split(letters, "")), lambda c: F.when(c == "l", "link").when(c == "d", "divide").when(c == "e", "exit"))
    return F.when(letters.rlike("^[lde]+$"), kinds)


def expand(kinds: Column, src_labels: Column, dst_labels: Column) -> Column:
    """Kinds in open-first order to operations: sources and destinations are used up in order; NULL if they don't come out even."""
    def step(acc: Column, kind: Column) -> Column:
        i, j = acc["i"], acc["j"]
        width = F.when(kind == "divide", 2).when(kind == "link", 1).otherwise(0)
        op = F.struct(
            kind.alias("kind"), F.get(src_labels, i).cast("int").alias("src"), F.when(width >= 1, F.get(dst_labels, j)).cast("int").alias("dst1"),
            F.when(width == 2, F.get(dst_labels, j + 1)).cast("int").alias("dst2"),
        )
        return F.struct((i + 1).alias("i"), (j + width).alias("j"), F.concat(acc["ops"], F.array(op)).alias("ops"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast(f"array<{OP}>").alias("ops"))
    done = F.aggregate(kinds, start, step)
    return F.when((done["i"] == F.size(src_labels)) & (done["j"] == F.size(dst_labels)), done["ops"])


def error(ops: Column) -> Column:
    """What is wrong with a list, or NULL: unknown kind, wrong number of destinations, a source or destination used twice, an exit
    after another kind (exits come first from the open end)."""
    dst = F.flatten(F.transform(ops, lambda x: F.array_compact(F.array(x["dst1"], x["dst2"]))))
    src = F.transform(ops, lambda x: x["src"])
    n = F.size(ops)
    exits = count(ops, "exit")
    given = lambda x: F.size(F.array_compact(F.array(x["dst1"], x["dst2"])))
    wrong = F.exists(ops, lambda x: given(x) != F.when(x["kind"] == "link", 1).when(x["kind"] == "divide", 2).otherwise(0))
    late_exit = F.size(F.filter(F.slice(ops, 1, exits), lambda x: x["kind"] != "exit")) > 0
    return (
        F.when(ops.isNull(), "not a list of operations")
        .when(F.exists(ops, lambda x: ~F.coalesce(x["kind"].isin(*ARITY), F.lit(False))), "unknown kind")
        .when(F.exists(ops, lambda x: x["src"].isNull()), "no source")
        .when(wrong, "wrong number of destinations")
        .when(F.size(F.array_distinct(src)) < n, "source used twice")
        .when(F.size(F.array_distinct(dst)) < F.size(dst), "destination used twice")
        .when((exits > 0) & late_exit, "exit after another operation")
    )
