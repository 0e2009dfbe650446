"""Mail as a data source: .eml files and mbox archives to the messages table, in batches and streams, and a numbered sink.

    register(spark)
    spark.read.format("mail").load("/mail/inbox")
    spark.readStream.format("mail").load("/mail/inbox")
    mails.write.format("mail").mode("overwrite").save("/corpus")      # columns class, number, mail

Partitions are planned by bytes: small files are bundled, an mbox is cut into byte ranges, and a message belongs to the range
that its `From ` line begins in. A mail that can't be read or parsed is a row with an `error`. A stream's offset is the
latest (modification time, path) it has seen, so files must arrive by a rename, as mail servers deliver them. The sink writes
every task's files aside; the commit gathers those of the tasks that succeeded and renames the folder, so the target holds
all of them or doesn't exist. Files are reached through pyarrow's file systems: any store that it knows will do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from threatloom.runtime import ship
from threatloom.sources.mime import MESSAGE, parse_message

PARTITION_BYTES = 32 << 20
#: Messages of an Arrow batch.
ROWS = 200
_LINE = re.compile(rb"(?m)^From ")


def store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


@dataclass
class Span(InputPartition):
    """Pieces (path, first byte, end) that one task reads; the end of a whole .eml is its size."""

    pieces: list[tuple[str, int, int]]

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        super().__init__(None)
        self.pieces = pieces


def found(path: str) -> list[tuple[int, str, int]]:
    """(modification time, path, bytes) of the mail files at or below a path, in this order."""
    from pyarrow import fs

    files, root = store(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((i.mtime_ns or 0, i.path, i.size) for i in infos if i.is_file and i.extension in ("eml", "mbox"))


def planned(files: list[tuple[int, str, int]], most: int) -> list[Span]:
    """Partitions of at most `most` bytes, one larger .eml excepted."""
    out: list[Span] = []
    held, size = [], 0
    for _, path, n in files:
        cuts = [(path, k, min(k + most, n)) for k in range(0, n, most)] if path.endswith(".mbox") and n > most else [(path, 0, n)]
        for piece in cuts:
            if held and size + piece[2] - piece[1] > most:
                out.append(Span(held))
                held, size = [], 0
            held.append(piece)
            size += piece[2] - piece[1]
    return out + ([Span(held)] if held else [])


def mbox_messages(read, start: int, end: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, message) of an mbox whose `From ` lines begin in [start, end). read(at, n) gives bytes."""
    # the byte before tells whether a line begins at the start; four behind the end complete the word
    base = max(0, start - 1)
    held = read(base, min(size, end + 4) - base)
    starts = [base + m.start() for m in _LINE.finditer(held) if start <= base + m.start() < end]
    if not starts:
        return
    # the last message goes on behind the range, up to the next line
    at = starts[-1] - base + 1
    while not (following := _LINE.search(held, at)) and base + len(held) < size:
        at = max(at, len(held) - 5)
        held += read(base + len(held), min(step, size - base - len(held)))
    stops = [*starts[1:], base + following.start() if following else size]
    for begin, stop in zip(starts, stops, strict=True):
        raw = held[begin - base : stop - base].partition(b"\n")[2]
        body = re.sub(rb"(?m)^>(>*From )", rb"\1", raw)
        yield begin, body[:-1] if body.endswith(b"\n\n") else body


class Reading:
    """What the batch and the stream reader share."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.known_tld_only = str(options.get("knownTldOnly", "true")).lower() == "true"

    def mails(self, piece: tuple[str, int, int]) -> Iterator[tuple[str, bytes]]:
        path, start, end = piece
        files, _ = store(self.path)
        with files.open_input_file(path) as f:
            if not path.endswith(".mbox"):
                yield path, f.read()
                return
            read = lambda at, n: (f.seek(at), f.read(n))[1]
            for at, raw in mbox_messages(read, start, end, f.size()):
                yield f"{path}#{at}", raw

    def rows(self, partition: Span):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(self.schema), []
        for piece in partition.pieces:
            try:
                for name, raw in self.mails(piece):
                    held.append(parse_message(name, raw, self.known_tld_only))
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
            except OSError as e:  # a file that is gone or can't be opened says so in its row
                held.append({"message_id": piece[0], "error": f"{type(e).__name__}: {e}"[:200]})
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


class MailReader(DataSourceReader, Reading):
    def __init__(self, schema: StructType, options: dict) -> None:
        Reading.__init__(self, schema, options)

    def partitions(self) -> list[Span]:
        return planned(found(self.path), self.most) or [Span([])]

    def read(self, partition: Span):
        yield from self.rows(partition)


class MailStream(DataSourceStreamReader, Reading):
    def __init__(self, schema: StructType, options: dict) -> None:
        Reading.__init__(self, schema, options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = found(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        key = lambda o: (o["time"], o["path"])
        return planned([f for f in found(self.path) if key(start) < f[:2] <= key(end)], self.most) or [Span([])]

    def read(self, partition: Span):
        yield from self.rows(partition)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and its files."""

    folder: str
    files: list[str]


class MailWriter(DataSourceWriter):
    """Numbered mails as <class>/<number>.eml, all or none."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.aside = f"{self.path}._aside-{uuid.uuid4().hex}"
        files, at = store(self.path)
        if not overwrite and files.get_file_info(at).type.name != "NotFound":
            raise FileExistsError(f"{self.path} holds a corpus already")

    def write(self, iterator) -> Written:
        task = uuid.uuid4().hex
        files, at = store(f"{self.aside}/{task}")
        names, made = [], set()
        for row in iterator:
            if not re.fullmatch(r"[A-Za-z0-9_-]+", row["class"] or "") or not re.fullmatch(r"[0-9]+", row["number"] or ""):
                raise ValueError(f"no file name: {row['class']}/{row['number']}")
            if row["class"] not in made:
                files.create_dir(f"{at}/{row['class']}", recursive=True)
                made.add(row["class"])
            names.append(f"{row['class']}/{row['number']}.eml")
            with files.open_output_stream(f"{at}/{names[-1]}") as out:
                out.write((row["mail"] or "").encode())
        return Written(task, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, aside = store(self.aside)
        _, at = store(self.path)
        done = [m for m in messages if m]
        names = [n for m in done for n in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two mails have one number")
        files.create_dir(f"{aside}/whole", recursive=True)
        for folder in {n.split("/")[0] for n in names}:
            files.create_dir(f"{aside}/whole/{folder}", recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: files.move(f"{aside}/{x[0]}/{x[1]}", f"{aside}/whole/{x[1]}"), [(m.folder, n) for m in done for n in m.files]))
        old = files.get_file_info(at).type.name != "NotFound"
        if old:
            files.move(at, f"{aside}/old")
        files.move(f"{aside}/whole", at)
        files.delete_dir(aside)

    def abort(self, messages) -> None:
        files, aside = store(self.aside)
        if files.get_file_info(aside).type.name != "NotFound":
            files.delete_dir(aside)


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(schema, self.options)

    def streamReader(self, schema: StructType) -> MailStream:
        return MailStream(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MailWriter:
        return MailWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(MailSource)
