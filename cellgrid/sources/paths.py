"""Existence checks through the Hadoop file system of a path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def require_exists(spark: SparkSession, path: str) -> None:
    if not exists(spark, path):
        raise ValueError(f"input {path} does not exist")


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    for c in candidates:
        if exists(spark, c):
            return c
    return None


def file_size(spark: SparkSession, path: str) -> int:
    fs, p = _fs_path(spark, path)
    return fs.getFileStatus(p).getLen()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, p = _fs_path(spark, src)
    _, q = _fs_path(spark, dst)
    if not fs.rename(p, q):
        raise OSError(f"could not move {src} to {dst}")


def rename_new(spark: SparkSession, src: str, dst: str) -> None:
    """One atomic rename; an error if the target exists."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    _, p = _fs_path(spark, src)
    _, q = _fs_path(spark, dst)
    context = hadoop.FileContext.getFileContext(q.toUri(), sc._jsc.hadoopConfiguration())
    context.rename(p, q, sc._gateway.new_array(hadoop.Options.Rename, 0))


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs_path(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, p = _fs_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs_path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The data files a read of ``path`` covers, in name order (a folder of
    part files reads like their concatenation)."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        raise ValueError(f"input {path} does not exist")
    if not fs.getFileStatus(p).isDirectory():
        return [str(p.toString())]
    names = []
    for st in fs.listStatus(p):
        n = st.getPath().getName()
        if st.isFile() and not n.startswith("_") and not n.startswith("."):
            names.append(str(st.getPath().toString()))
    if not names:
        raise ValueError(f"{path} holds no data files")
    return sorted(names)


def qualified(spark: SparkSession, path: str) -> str:
    """One spelling per place: scheme, authority and absolute path."""
    fs, p = _fs_path(spark, path)
    return str(fs.makeQualified(p).toString()).rstrip("/")


def head_line(spark: SparkSession, path: str, stop) -> tuple[str, int, bool]:
    """``(last line, number of lines before it, found)`` of one file, read on the
    driver through the Hadoop file system (decompressed by its codec) until
    ``stop(line)`` is true.  Lines pass one at a time and none but the last is
    kept, so a header may be of any length; without a match the whole file has
    been passed over."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs_path(spark, path)
    stream = fs.open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    if codec is not None:
        stream = codec.createInputStream(stream)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    at, last = 0, ""
    try:
        while (line := reader.readLine()) is not None:
            if stop(line):
                return line, at, True
            at, last = at + 1, line
    finally:
        reader.close()
    return last, at, False
