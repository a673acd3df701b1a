"""One-file-per-row sink as a Python DataSource (SNK-3/4).

    spark.dataSource.register(FilesDataSource)
    files.select("file_name", "content").write.format("quire_files") \\
         .mode("append").option("path", out_uri).save()

Each task writes its rows to ``<path>/<file_name>`` through ``pyarrow.fs``
(local paths, ``file://``, ``hdfs://``, ``s3://`` ...), first under a hidden
temporary name and then moved into place, so a retried task simply rewrites
its own files and a half-written file is never visible.  Each task also writes the list
of its files; ``commit`` moves the lists of the tasks that count to ``_FILES/part-<n>``, so the
driver sees one name per task, never the file names.  Names are validated: no
absolute paths, no '..' segments.
"""
from __future__ import annotations

import uuid

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class _Written(WriterCommitMessage):
    def __init__(self, manifest):
        self.manifest = manifest


def _safe(name: str) -> str:
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or name.startswith("/") or ".." in parts:
        raise ValueError(f"unsafe export file name: {name!r}")
    return "/".join(parts)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, base = _fs(self.path)
        manifest = f"_FILES/.{uuid.uuid4().hex}"
        fs.create_dir(f"{base.rstrip('/')}/_FILES", recursive=True)
        with fs.open_output_stream(f"{base.rstrip('/')}/{manifest}") as listed:
            self._write(fs, base, iterator, listed)
        return _Written(manifest)

    def _write(self, fs, base, iterator, listed):
        for row in iterator:
            rel = _safe(row["file_name"])
            dest = f"{base.rstrip('/')}/{rel}"
            folder = dest.rsplit("/", 1)[0]
            fs.create_dir(folder, recursive=True)
            tmp = f"{folder}/.{uuid.uuid4().hex}.tmp"
            data = row["content"]
            with fs.open_output_stream(tmp) as out:
                out.write(bytes(data) if data is not None else b"")
            fs.move(tmp, dest)
            listed.write((rel + "\n").encode("utf-8"))

    def commit(self, messages):
        fs, base = _fs(self.path)
        for i, m in enumerate(m for m in messages if m is not None):
            fs.move(f"{base.rstrip('/')}/{m.manifest}", f"{base.rstrip('/')}/_FILES/part-{i:05d}")

    def abort(self, messages):
        pass


class FilesDataSource(DataSource):
    @classmethod
    def name(cls):
        return "quire_files"

    def schema(self):
        return "file_name string, content binary"

    def writer(self, schema, overwrite):
        path = self.options.get("path")
        if not path:
            raise ValueError("option 'path' is required")
        fs, base = _fs(path)
        fs.create_dir(base, recursive=True)
        return FilesWriter(path)


def write_files(files, path: str) -> None:
    """Write an export DataFrame (file_name, content) as individual files."""
    from quire.session import ship_package

    spark = files.sparkSession
    ship_package(spark)
    spark.dataSource.register(FilesDataSource)
    files.select("file_name", "content").write.format("quire_files").mode("append").option("path", path).save()
