"""Tensor files as tables of (file, name, dtype, shape, data), and back.

A task opens its files by range: headers alone where ``data`` isn't asked for,
and otherwise one tensor at a time, so that no file is held whole but those of
a format without an index (onnx). Read: safetensors, the compressed container
(magic ``MST\\0``), gguf, onnx and array folders of .npy files. Written:
safetensors, the container and array folders.
"""

from __future__ import annotations

import ast
import json
import math
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.operators.codec import compress, decompress

SCHEMA = "file string, name string, dtype string, shape array<long>, size long, data binary"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
MAGIC, VERSION = b"MST\x00", 1
CODEC_TYPE = {"F16": "fp16", "BF16": "bf16", "F32": "fp32"}
BYTES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
NPY = {"<f8": "F64", "<f4": "F32", "<f2": "F16", "<i8": "I64", "<i4": "I32", "<i2": "I16", "|i1": "I8", "|u1": "U8", "|b1": "BOOL", "<V2": "BF16", "|V2": "BF16"}
#: gguf type number: (name, values in a block, bytes of a block)
GGUF_TYPES = {0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34), 9: ("Q8_1", 32, 36), 10: ("Q2_K", 256, 84), 11: ("Q3_K", 256, 110), 12: ("Q4_K", 256, 144), 13: ("Q5_K", 256, 176), 14: ("Q6_K", 256, 210), 15: ("Q8_K", 256, 292), 24: ("I8", 1, 1), 25: ("I16", 1, 2), 26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 30: ("BF16", 1, 2)}
ONNX_TYPES = {1: "F32", 2: "U8", 3: "I8", 5: "I16", 6: "I32", 7: "I64", 9: "BOOL", 10: "F16", 11: "F64", 16: "BF16"}


def _safetensors(f, want):
    n = struct.unpack("<Q", f.read_at(8, 0))[0]
    head = json.loads(f.read_at(n, 8))
    for name, t in head.items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            yield name, t["dtype"], t["shape"], b - a, f.read_at(b - a, 8 + n + a) if want else None


def _container(f, want):
    magic, version, n = struct.unpack("<4sIQ", f.read_at(16, 0))
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a container of version {VERSION}")
    for name, t in json.loads(f.read_at(n, 16))["tensors"].items():
        data = None
        if want:
            data = decompress(f.read_at(t["compressed_size"], 16 + n + t["offset"]), t["original_size"], CODEC_TYPE.get(t["dtype"], "raw"))
        yield name, t["dtype"], t["shape"], t["original_size"], data


def _gguf(f, want):
    at = 0

    def take(form):
        nonlocal at
        n = struct.calcsize(form)
        out = struct.unpack(form, f.read_at(n, at))
        at += n
        return out[0]

    def text():
        nonlocal at
        n = take("<Q")
        out = f.read_at(n, at).decode("utf-8", "replace")
        at += n
        return out

    scalar = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}

    def value(kind):
        if kind == 8:
            return text()
        if kind == 9:
            inner, n = take("<I"), take("<Q")
            return [value(inner) for _ in range(n)]
        return take(scalar[kind])

    if take("<I") != 0x46554747:
        raise ValueError("not a gguf file")
    if take("<I") not in (2, 3):
        raise ValueError("a gguf version that isn't known")
    n_tensors, n_values = take("<Q"), take("<Q")
    meta = {text(): value(take("<I")) for _ in range(n_values)}
    infos = []
    for _ in range(n_tensors):
        name, dims = text(), take("<I")
        shape = [take("<Q") for _ in range(dims)]
        infos.append((name, shape, take("<I"), take("<Q")))
    step = int(meta.get("general.alignment", 32))
    start = -(-at // step) * step
    for name, shape, kind, offset in infos:
        label, values, size = GGUF_TYPES[kind]
        n = math.prod(shape) // values * size
        yield name, label, shape, n, f.read_at(n, start + offset) if want else None


def _fields(data: memoryview):
    """(number, value) of a protobuf message; length-delimited values as slices."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
        elif wire == 2:
            n = number()
            yield tag >> 3, data[at : at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError("not a protobuf message")


def _varints(part) -> list[int]:
    if isinstance(part, int):
        return [part]
    out, v, shift = [], 0, 0
    for b in part:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v)
            v = shift = 0
    return out


def _onnx(f, want):
    model = memoryview(f.read_at(f.size(), 0))
    for graph in (v for k, v in _fields(model) if k == 7):
        for tensor in (v for k, v in _fields(graph) if k == 5):
            dims, kind, name, raw, floats, ints = [], 0, "", None, b"", []
            for k, v in _fields(tensor):
                if k == 1:
                    dims += _varints(v)
                elif k == 2:
                    kind = v
                elif k == 8:
                    name = bytes(v).decode()
                elif k == 9:
                    raw = bytes(v)
                elif k in (4, 10):  # float_data, double_data
                    floats += bytes(v)
                elif k in (5, 7):  # int32_data, int64_data
                    ints += _varints(v)
            label = ONNX_TYPES.get(kind, f"onnx{kind}")
            if raw is None:
                width = BYTES.get(label, 8)
                raw = floats or b"".join((x % (1 << 8 * width)).to_bytes(width, "little") for x in ints)
            yield name, label, dims, len(raw), raw if want else None


def _npy(f, want):
    if f.read_at(6, 0) != b"\x93NUMPY":
        raise ValueError("not an npy file")
    long = f.read_at(1, 6)[0] > 1
    n = struct.unpack("<I" if long else "<H", f.read_at(4 if long else 2, 8))[0]
    start = (12 if long else 10) + n
    head = ast.literal_eval(f.read_at(n, start - n).decode("latin-1"))
    size = f.size() - start
    yield None, NPY.get(head["descr"], head["descr"]), list(head["shape"]), size, f.read_at(size, start) if want else None


READERS = {"safetensors": _safetensors, "container": _container, "gguf": _gguf, "onnx": _onnx, "npy": _npy}
ENDINGS = {"safetensors": "*.safetensors", "container": "*.mst", "gguf": "*.gguf", "onnx": "*.onnx", "npy": "*.npy"}


def sniff(head: bytes) -> str | None:
    """The format that the first 16 bytes of a file show."""
    if head[:4] == MAGIC:
        return "container"
    if head[:4] == b"GGUF":
        return "gguf"
    if head[:6] == b"\x93NUMPY":
        return "npy"
    if len(head) >= 9 and head[8:9] == b"{" and struct.unpack("<Q", head[:8])[0] < 1 << 32:
        return "safetensors"
    return "onnx" if head[:1] == b"\x08" else None


def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_file(inner)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, _TYPES)], _NAMES)


def read_tensors(spark: SparkSession, path: str, format: str | None = None, data: bool = True) -> DataFrame:
    """Every tensor of the files under ``path``; each file's own bytes tell its format unless one is named.

    Names of .npy files are their paths under the last folder of ``path``, without the ending.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", ENDINGS.get(format, "*")).load(path).select("path")
    root = "/" + path.rstrip("/").split("/")[-1] + "/"

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                with _open(p) as f:
                    kind = format or sniff(f.read_at(min(16, f.size()), 0))
                    if kind is None:
                        continue
                    for name, dtype, shape, size, raw in READERS[kind](f, data):
                        yield _batch([(p, name if name is not None else p.split(root)[-1].removesuffix(".npy"), dtype, [int(x) for x in shape], size, raw)])

    return files.mapInArrow(run, SCHEMA)


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format) of every file, from the first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches):
        for b in batches:
            kinds = []
            for p in b.column(0).to_pylist():
                with _open(p) as f:
                    kinds.append(sniff(f.read_at(min(16, f.size()), 0)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string())], ["path", "length", "format"])

    return files.mapInArrow(run, "path string, length long, format string")


def _as_safetensors(rows):
    head, at = {}, 0
    for name, dtype, shape, data in rows:
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    text = json.dumps(head, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    yield struct.pack("<Q", len(text)) + text
    for *_, data in rows:
        yield data


def _as_container(rows):
    packed = [compress(data, CODEC_TYPE.get(dtype, "raw")) for _, dtype, _, data in rows]
    head, at = {}, 0
    for (name, dtype, shape, data), p in zip(rows, packed):
        head[name] = {"dtype": dtype, "shape": shape, "original_size": len(data), "compressed_size": len(p), "offset": at}
        at += len(p)
    text = json.dumps({"tensors": head, "compression": {"method": "zstd", "level": 3, "byte_grouping": True}, "metadata": {}}).encode()
    yield struct.pack("<4sIQ", MAGIC, VERSION, len(text)) + text
    yield from packed


def _as_npy(row):
    _, dtype, shape, data = row
    descr = next(k for k, v in NPY.items() if v == dtype)
    text = repr({"descr": descr, "fortran_order": False, "shape": tuple(shape)}).encode("latin-1")
    text += b" " * (-(len(text) + 11) % 64) + b"\n"
    yield b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text
    yield data


def write_tensors(df: DataFrame, path: str, format: str = "safetensors") -> DataFrame:
    """Files under ``path``, one for each value of ``file`` (for npy one for each tensor); (file, tensors, bytes) of each.

    Files keep their paths from the folder that all of them are in, so equal
    names in different folders stay apart; arrays of several files go to a
    folder for each.

    A file is written beside its place and then moved there, so a task that is
    run again replaces what it wrote. The result is already there: it isn't lazy.
    """
    if format not in ("safetensors", "container", "npy"):
        raise ValueError(f"{format} isn't written")
    if "://" not in path and not path.startswith("/"):
        raise ValueError("the path has to be absolute")

    def put(name, pieces):
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(f"{path.rstrip('/')}/{name}") if "://" in path else (fs.LocalFileSystem(), f"{path.rstrip('/')}/{name}")
        where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        draft, n = f"{inner}.{uuid.uuid4().hex}", 0
        with where.open_output_stream(draft) as out:
            for p in pieces:
                out.write(p)
                n += len(p)
        where.move(draft, inner)
        return n

    ends = df.agg(F.min("file").alias("low"), F.max("file").alias("high")).first()
    low, high = ((x or "").rstrip("/") for x in ends)
    shared = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    root = low[:shared].rfind("/") + 1
    several = low != high

    def run(batches):
        held, rows, done = None, [], []

        def close():
            if rows:
                folder, slash, name = held.rstrip("/")[root:].rpartition("/")
                stem = folder + slash + name.rsplit(".", 1)[0]
                if format == "npy":
                    n = sum(put(f"{stem}/{r[0]}.npy" if several else f"{r[0]}.npy", _as_npy(r)) for r in rows)
                else:
                    n = put(stem + (".mst" if format == "container" else ".safetensors"), (_as_container if format == "container" else _as_safetensors)(rows))
                done.append((stem, len(rows), n))
                rows.clear()

        for b in batches:
            for file, *row in zip(*(b.column(c).to_pylist() for c in ("file", "name", "dtype", "shape", "data"))):
                if file != held:
                    close()
                    held = file
                rows.append(tuple(row))
        close()
        c = list(zip(*done)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())], ["file", "tensors", "bytes"])

    from loamsift.session import materialize

    laid = df.select("file", "name", "dtype", "shape", "data").repartition("file").sortWithinPartitions("file", "name")
    return materialize(laid.mapInArrow(run, "file string, tensors long, bytes long"), "written")


def convert(spark: SparkSession, source: str, target: str, format: str) -> DataFrame:
    """Every file under ``source`` in another format under ``target``."""
    return write_tensors(read_tensors(spark, source), target, format)
