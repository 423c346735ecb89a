"""Label images: uncompressed TIFF files to a table of frames and back."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.schemas import FRAMES

_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image of an uncompressed single-channel TIFF, strips in either byte order, as 32-bit labels."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in _SIZES:
            letter, size = _SIZES[kind]
            where = at + 10 + 12 * i if n * size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{letter}", data, where)
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
        raise ValueError("compressed or colour images are no label images")
    w, h, bits = tags[256][0], tags[257][0], tags.get(258, (1,))[0]
    if bits not in (8, 16, 32):
        raise ValueError(f"{bits} bits a pixel")
    raw = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279]))
    return np.frombuffer(raw, f"{order}u{bits // 8}", w * h).reshape(h, w).astype(np.uint32)


def encode_tiff(image: np.ndarray) -> bytes:
    h, w = image.shape
    pixels = np.ascontiguousarray(image, "<u4").tobytes()
    entries = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(pixels)), (339, 3, 1)]
    table = b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries)
    return b"II" + struct.pack("<HI", 42, 8 + len(pixels)) + pixels + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0)


def natural_key(name: str) -> Column:
    """Sorts file names with numbers by their values: digits are padded to 12."""
    padded = F.regexp_replace(F.lower(F.element_at(F.split(name, "/"), -1)), r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


def read_label_folder(spark: SparkSession, folder: str, dataset_id: str) -> DataFrame:
    """frames(dataset_id, t, height, width, pixels) of a folder of TIFF files, t by natural order of names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(folder)
    # names only: a folder's listing is small beside its pixels
    from cellweave.operators.positions import with_positions

    order = with_positions(files.select("path"), [], [natural_key("path"), F.col("path")], "t")

    def decode(batches):
        for pdf in batches:
            images = [decode_tiff(x) for x in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "height": [i.shape[0] for i in images], "width": [i.shape[1] for i in images], "pixels": [i.astype("<u4").tobytes() for i in images]})

    images = files.select("path", "content").mapInPandas(decode, "path STRING, height INT, width INT, pixels BINARY")
    return images.join(order, "path").select(F.lit(dataset_id).alias("dataset_id"), F.col("t").cast("int").alias("t"), "height", "width", "pixels")


def stack_errors(frames: DataFrame) -> DataFrame:
    """(dataset_id, error): stacks whose frames differ in shape or whose pixels don't fit it."""
    per = frames.groupBy("dataset_id").agg(F.countDistinct("height", "width").alias("shapes"), F.max((F.length("pixels") != 4 * F.col("height") * F.col("width")).cast("int")).alias("bad"))
    error = F.when(F.col("shapes") > 1, "frames of different shapes").when(F.col("bad") == 1, "pixels don't fit the shape")
    return per.select("dataset_id", error.alias("error")).where("error IS NOT NULL")


def write_label_folder(frames: DataFrame, folder: str) -> None:
    """A TIFF file per frame, written by the tasks; refuses to overwrite a file. folder must be shared by all executors."""

    def write(rows) -> None:
        from pathlib import Path

        for r in rows:
            target = Path(folder) / r["dataset_id"]
            target.mkdir(parents=True, exist_ok=True)
            with (target / f"frame_{r['t']:06d}.tif").open("xb") as f:
                f.write(encode_tiff(np.frombuffer(bytes(r["pixels"]), "<u4").reshape(r["height"], r["width"])))

    frames.select(*[c.split()[0] for c in FRAMES.split(", ")]).foreachPartition(write)
