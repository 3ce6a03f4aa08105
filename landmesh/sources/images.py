"""Rasters as pictures and as chunked arrays, in formats that need no library."""

from __future__ import annotations

import json
import os
import struct
import zlib
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray picture of whole numbers from 0 to 255."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = gray.shape
    lines = np.c_[np.zeros((h, 1), np.uint8), gray.astype(np.uint8)].tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def pixels(data: bytes) -> np.ndarray:
    """The numbers of a picture that ``png`` made."""
    at, body, shape = 8, b"", (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h = struct.unpack(">II", part[:8])
            shape = (h, w)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], shape[1] + 1)[:, 1:]


def _square(pdf: pd.DataFrame, value: str, fill: float = 0.0) -> np.ndarray:
    out = np.full((int(pdf.r.max()) + 1, int(pdf.c.max()) + 1), fill)
    out[pdf.r, pdf.c] = pdf[value]
    return out


def quicklooks(cells: DataFrame, value: str) -> DataFrame:
    """One picture per raster, its smallest value black and its largest white: sid and png."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _square(pdf, value)
        lo, hi = a.min(), a.max()
        gray = np.floor((a - lo) / (hi - lo) * 255 + 0.5) if hi > lo else np.zeros(a.shape)
        return pd.DataFrame({"sid": [pdf.sid.iloc[0]], "png": [png(gray)]})

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, png binary")


def read_quicklooks(pictures: DataFrame) -> DataFrame:
    """The pixels of pictures: sid, r, c and gray."""

    def run(batches):
        for pdf in batches:
            for sid, data in zip(pdf.sid, pdf.png, strict=True):
                g = pixels(data)
                r, c = np.mgrid[: g.shape[0], : g.shape[1]]
                yield pd.DataFrame({"sid": sid, "r": r.ravel(), "c": c.ravel(), "gray": g.ravel().astype(np.int64)})

    return pictures.mapInPandas(run, "sid bigint, r bigint, c bigint, gray bigint")


def write_zarr(cells: DataFrame, value: str, folder: str) -> DataFrame:
    """Each raster as an array of a Zarr (version 2) group on a mounted folder, one chunk a raster: sid and path.

    A file is written whole and renamed, so a task that runs again replaces its own.
    """
    root = urlparse(folder).path
    _put(f"{root}/.zgroup", json.dumps({"zarr_format": 2}).encode())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, path = _square(pdf, value, np.nan).astype("<f4"), f"{root}/{pdf.sid.iloc[0]}/{value}"
        meta = {"zarr_format": 2, "shape": list(a.shape), "chunks": list(a.shape), "dtype": "<f4", "compressor": {"id": "zlib", "level": 4}, "fill_value": "NaN", "order": "C", "filters": None}
        _put(f"{root}/{pdf.sid.iloc[0]}/.zgroup", json.dumps({"zarr_format": 2}).encode())
        _put(f"{path}/0.0", zlib.compress(a.tobytes(), 4))
        _put(f"{path}/.zarray", json.dumps(meta).encode())
        return pd.DataFrame({"sid": [pdf.sid.iloc[0]], "path": [path]})

    return cells.groupBy("sid").applyInPandas(run, "sid bigint, path string")


def _put(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def read_zarr(arrays: DataFrame) -> DataFrame:
    """The cells of arrays of one chunk: sid, r, c and value (null for the fill value)."""

    def run(batches):
        for pdf in batches:
            for sid, path in zip(pdf.sid, pdf.path, strict=True):
                with open(f"{path}/.zarray") as f:
                    meta = json.load(f)
                with open(f"{path}/0.0", "rb") as f:
                    a = np.frombuffer(zlib.decompress(f.read()), meta["dtype"]).reshape(meta["shape"])
                r, c = np.mgrid[: a.shape[0], : a.shape[1]]
                yield pd.DataFrame({"sid": sid, "r": r.ravel(), "c": c.ravel(), "value": a.ravel().astype(float)})

    return arrays.mapInPandas(run, "sid bigint, r bigint, c bigint, value double")
