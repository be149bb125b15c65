"""One file for each document, written by many tasks, with nothing left of a task that failed.

Spark's own writers make a file for each task, so a document with one root would be a task's whole output. This data
source takes rows (name, piece), a document's rows standing together and in order, and writes header, pieces and footer
of each document to a file of its own under a staging folder; the driver moves them into place once all tasks are done.
Files are opened by pyarrow, so the folder may be of any kind that it knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .results import cvat_tracks


@dataclass
class Staged(WriterCommitMessage):
    """Documents that a task wrote: (path in the staging folder, name of the file)."""

    files: list[tuple[str, str]]


class DocumentSource(DataSource):
    """Format ``documents`` with the options path, header, footer, separator, extension."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, piece string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(dict(self.options))


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = {"header": "", "footer": "", "separator": "\n", "extension": "txt"} | options
        self.staging = f"{self.options['path'].rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def _open(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def write(self, iterator: Iterator) -> Staged:
        store, root = self._open(self.staging)
        folder = f"{root}/{uuid.uuid4().hex}"  # of this attempt alone
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        now, out = None, None
        o = self.options
        for row in iterator:
            name, piece = row["name"], row["piece"]
            if out is None or name != now:
                if out is not None:
                    out.write(o["footer"].encode())
                    out.close()
                now = name
                files.append((f"{folder}/{len(files)}", f"{name}.{o['extension']}"))
                out = store.open_output_stream(files[-1][0])
                out.write((o["header"] + piece).encode())
            else:
                out.write((o["separator"] + piece).encode())
        if out is not None:
            out.write(o["footer"].encode())
            out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self._open(self.options["path"])
        names = [name for m in messages if m for _, name in m.files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("the rows of a document were dealt to several tasks")
        for m in messages:
            for path, name in m.files if m else ():
                store.move(path, f"{root.rstrip('/')}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = self._open(self.staging)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def write_documents(pieces: DataFrame, folder: str, order: list[str], **options: str) -> None:
    """pieces(name, piece, and the order's columns) as a file ``name`` for each name, its pieces in order."""
    pieces.sparkSession.dataSource.register(DocumentSource)
    dealt = pieces.repartition("name").sortWithinPartitions("name", *order).select("name", "piece")
    writer = dealt.write.format("documents").option("path", folder).mode("append")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()


def _xml(value: Column | str) -> Column:
    """Text as the value of an attribute."""
    out = (F.col(value) if isinstance(value, str) else value).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<attribute name="{name}">'), _xml(value), F.lit("</attribute>"))


def cvat_pieces(boxes: DataFrame, events: DataFrame, meta: DataFrame) -> DataFrame:
    """name (of the match), kind, number, piece: a match's metadata, its tracks with all boxes, and a tag for each event.

    boxes as for results.cvat_tracks, events(match_id, type, start_frame, player, confidence), meta(match_id, key, value).
    """
    name = F.col("match_id").cast("string").alias("name")
    b = lambda c: lambda x: _xml(x[c])

    def box(x: Column) -> Column:
        sides = [F.concat(F.lit(f' {c}="'), b(c)(x), F.lit('"')) for c in ("xtl", "ytl", "xbr", "ybr")]
        frame = F.concat(F.lit('<box frame="'), x["frame_id"].cast("string"), F.lit('"'))
        return F.concat(frame, *sides, F.lit(' outside="0" occluded="0" keyframe="1">'), _attribute("confidence", x["confidence"]), F.lit("</box>"))

    tracks = cvat_tracks(boxes).select(
        name, F.lit(1).alias("kind"), F.col("id").cast("long").alias("number"),
        F.concat(
            F.lit('<track id="'), F.col("id").cast("string"), F.lit('" label="'), _xml("label"), F.lit('" source="auto">'),
            F.array_join(F.transform("boxes", box), ""), F.lit("</track>"),
        ).alias("piece"),
    )
    players = F.coalesce(_attribute("involved_players", F.col("player")), F.lit(""))
    tags = events.select(
        name, F.lit(2).alias("kind"), F.col("start_frame").cast("long").alias("number"),
        F.concat(
            F.lit('<tag label="'), _xml("type"), F.lit('" frame="'), F.col("start_frame").cast("string"), F.lit('" source="auto">'),
            _attribute("confidence", F.format_string("%.3f", "confidence")), players, F.lit("</tag>"),
        ).alias("piece"),
    )
    entry = F.array_sort(F.collect_list(F.concat(F.lit('<entry key="'), _xml("key"), F.lit('">'), _xml("value"), F.lit("</entry>"))))
    head = meta.groupBy("match_id").agg(entry.alias("e"))
    head = head.select(name, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("number"), F.concat(F.lit("<meta>"), F.array_join("e", ""), F.lit("</meta>")).alias("piece"))
    return head.unionByName(tracks).unionByName(tags)


def write_cvat_documents(boxes: DataFrame, events: DataFrame, meta: DataFrame, folder: str) -> None:
    """An annotation file for each match, with metadata, tracks and tags below one root."""
    head = '<?xml version="1.0" encoding="utf-8"?>\n<annotations><version>1.1</version>\n'
    write_documents(cvat_pieces(boxes, events, meta), folder, ["kind", "number", "piece"], header=head, footer="\n</annotations>\n", extension="xml")


def write_coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, folder: str) -> None:
    """A COCO file for each source, its three arrays an element a line."""
    parts = []
    for i, (df, part) in enumerate(((images, "images"), (annotations, "annotations"), (categories, "categories"))):
        fields = F.to_json(F.struct("id", *[c for c in df.columns if c not in ("source", "id")]))
        n = F.row_number().over(_window("source", "id")).cast("long")
        lead = F.concat(F.lit("" if not i else "],\n"), F.lit(f'"{part}": ['))
        parts.append(df.select(F.col("source").cast("string").alias("name"), F.lit(2 * i + 1).alias("kind"), n.alias("number"), F.concat(F.when(n == 1, "").otherwise(","), fields).alias("piece")))
        names = images.select(F.col("source").cast("string").alias("name")).distinct()
        parts.append(names.select("name", F.lit(2 * i).alias("kind"), F.lit(0).cast("long").alias("number"), lead.alias("piece")))
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    write_documents(pieces, folder, ["kind", "number"], header="{", footer="]}\n", extension="json")


def _window(key: str, order: str):
    from pyspark.sql import Window as W

    return W.partitionBy(key).orderBy(order)


def read_meta(spark, path: str) -> DataFrame:
    """document, key, value of annotation files' metadata."""
    schema = "entry array<struct<_VALUE string, _key string>>"
    rows = spark.read.format("xml").option("rowTag", "meta").schema(schema).load(path).select(F.input_file_name().alias("document"), F.explode("entry").alias("e"))
    return rows.select("document", F.col("e._key").alias("key"), F.col("e._VALUE").alias("value"))
