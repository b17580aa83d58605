"""Images in rows and files: sizes from their headers, screens of steps that lack one, and images out of nested columns into files."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stepwise.operators.scorer import resolved

# Kinds of images, by their formats' own codes, and the name of an image that is not written.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
JPEG_NO_FRAME = (0xC4, 0xC8, 0xCC)
UNWRITTEN = "PIL.Image"


class Header(NamedTuple):
    suffix: str
    width: int
    height: int
    mode: str


def _png(d: bytes) -> Header | None:
    if d[:8] != b"\x89PNG\r\n\x1a\n" or len(d) < 26 or d[12:16] != b"IHDR":
        return None
    width, height = struct.unpack(">II", d[16:24])
    return Header("png", width, height, PNG_MODES.get(d[25], "RGB"))


def _jpeg(d: bytes) -> Header | None:
    """The first frame's header: segments are passed by their lengths."""
    if d[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(d) and d[at] == 0xFF:
        marker = d[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in JPEG_NO_FRAME:
            height, width = struct.unpack(">HH", d[at + 5 : at + 9])
            return Header("jpg", width, height, JPEG_MODES.get(d[at + 9], "RGB"))
        else:
            at += 2 + int.from_bytes(d[at + 2 : at + 4], "big")
    return None


def _webp(d: bytes) -> Header | None:
    if d[:4] != b"RIFF" or d[8:12] != b"WEBP" or len(d) < 30:
        return None
    if d[12:16] == b"VP8X":
        return Header("webp", 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little"), "RGBA" if d[20] & 0x10 else "RGB")
    if d[12:16] == b"VP8L":
        bits = int.from_bytes(d[21:25], "little")
        return Header("webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA" if bits >> 28 & 1 else "RGB")
    width, height = struct.unpack("<HH", d[26:30])
    return Header("webp", width & 0x3FFF, height & 0x3FFF, "RGB")


def header(data: bytes | None) -> Header | None:
    """Format, size and mode of a PNG, JPEG or WebP image, from its header alone; null for anything else."""
    return (_png(data) or _jpeg(data) or _webp(data)) if data else None


#: The type of a screen, and of an image that has left its bytes.
SCREEN = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


@F.pandas_udf(SCREEN)
def size_of(content: pd.Series) -> pd.DataFrame:
    found = [header(x) for x in content]
    return pd.DataFrame({"width": [h and h.width for h in found], "height": [h and h.height for h in found]}, dtype="object")


def with_screen_size(spark: SparkSession, steps: DataFrame, folder: str) -> DataFrame:
    """``steps`` whose missing screen_size comes from the header of their image below ``folder``; null where there is none.

    Only images that such steps name are looked into, each once, and only
    their sizes are joined; steps with a size don't move for them.
    """
    lacks = F.col("screen_size").isNull() & F.col("screenshot_before").isNotNull()
    root = folder if "://" in folder else f"file://{folder}"
    name = resolved(F.col("screenshot_before"), root)
    name = F.when(name.startswith("/"), F.concat(F.lit("file://"), name)).otherwise(name)
    wanted = steps.where(lacks).select(name.alias("_path")).distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # Spark writes file:/ for what others write as file:///.
    path = F.regexp_replace("path", "^file:/+", "file:///")
    sizes = files.select(path.alias("_path"), "content").join(wanted, "_path", "left_semi").select("_path", size_of("content").alias("_size"))
    kind = steps.schema["screen_size"].dataType
    found = F.when(F.col("_size.width").isNotNull(), F.col("_size").cast(kind))
    given = steps.where(~lacks)
    rest = steps.where(lacks).withColumn("_path", name).join(sizes, "_path", "left").withColumn("screen_size", found)
    return given.unionByName(rest.select(*steps.columns))


# Images in nested columns.


def is_image(kind: T.DataType) -> bool:
    """Whether a type is that of an image: a struct of ``bytes`` (binary) and ``path``."""
    return isinstance(kind, T.StructType) and set(kind.names) == {"bytes", "path"} and isinstance(kind["bytes"].dataType, T.BinaryType)


def portable_type(kind: T.DataType, written: bool) -> T.DataType:
    """``kind`` with each image, at any depth, as its path or type, size and mode."""
    if is_image(kind):
        told = {"path" if written else "type": T.StringType(), "size": T.ArrayType(T.IntegerType()), "mode": T.StringType()}
        return T.StructType([T.StructField(k, v) for k, v in told.items()])
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, portable_type(f.dataType, written)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(portable_type(kind.elementType, written))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, portable_type(kind.valueType, written))
    return kind


def portable(value: Any, kind: T.DataType, name: str, save: Callable[[bytes, str], str] | None) -> Any:
    """A value of type ``kind`` with its images replaced; ``save`` takes an image's bytes and its field's name, and gives a path."""
    if value is None:
        return None
    if is_image(kind):
        data = value["bytes"]
        h = header(data)
        facts = {"size": [h.width, h.height] if h else None, "mode": h.mode if h else None}
        if save is None:
            return {"type": UNWRITTEN, **facts}
        # An image that has a path but no bytes is in its file already.
        return {"path": save(data, name) if data is not None else value["path"], **facts}
    if isinstance(kind, T.StructType):
        return {f.name: portable(value[f.name], f.dataType, f.name, save) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [portable(x, kind.elementType, name, save) for x in value]
    if isinstance(kind, T.MapType):
        return [(k, portable(v, kind.valueType, str(k), save)) for k, v in value]
    return value


def _saver(folder: str) -> Callable[[bytes, str], str]:
    """Writes an image under a name made of its digest and field: an attempt that is repeated writes the same, and no file is seen half."""
    system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    system.create_dir(root, recursive=True)

    def save(data: bytes, name: str) -> str:
        h = header(data)
        file = f"{hashlib.sha256(data).hexdigest()[:32]}_{''.join(c if c.isalnum() else '_' for c in name)}.{h.suffix if h else 'bin'}"
        if system.get_file_info(f"{root}/{file}").type == fs.FileType.NotFound:
            part = f"{root}/.{file}.{uuid4().hex}"
            with system.open_output_stream(part, compression=None) as out:
                out.write(data)
            system.move(part, f"{root}/{file}")
        return f"{folder}/{file}"

    return save


def portable_images(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` with each image struct (bytes, path), at any depth of structs, lists and maps, as {path, size, mode}.

    Its bytes become a file below ``folder`` (shared storage on a cluster),
    written by the tasks and named by its digest and field, so equal images
    are one file; the rows that name files are their index, and files that no row
    names are of lost attempts.  Without a folder nothing is written, and the
    path is replaced by a type.  Sizes are null for unknown formats.
    """
    kind = df.schema
    out = portable_type(kind, folder is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        save, schema = None if folder is None else _saver(folder), to_arrow_schema(out)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([portable(r, kind, "", save) for r in batch.to_pylist()], schema=schema)

    return df.mapInArrow(run, out)
