"""Collection XML and M3U8: writers, readers, and the report of what an export lacks."""

from __future__ import annotations

import uuid
from xml.sax.saxutils import quoteattr

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cratewise.functions import keys as ks, text as tx
from cratewise.functions.numbers import half_up, settle
from cratewise.operators.beats import beat_at_or_before, beat_time, first_beat_from, with_segments
from cratewise.operators.ordered import with_neighbour, with_position

TEMPO = "struct<_Inizio:string,_Bpm:string,_Metro:string,_Battito:int>"
MARK = "struct<_Name:string,_Type:string,_Start:string,_Num:string>"


def export_rows(tracks: DataFrame) -> DataFrame:
    """The effective view reduced to what an export carries."""
    t = F.col("tags")
    return tracks.select(
        "id", F.col("name").alias("filename"), "relative_path", "cues", t["title"].alias("title"), t["artist"].alias("artist"),
        t["album"].alias("album"), t["genre"].alias("genre"), t["year"].alias("year"), t["track_number"].alias("track_number"),
        t["comment"].alias("comment"), "duration_sec", "size_bytes", t["bitrate_kbps"].alias("bitrate_kbps"),
        t["sample_rate"].alias("sample_rate"), "bpm", F.col("tonic").alias("key_tonic"), F.col("mode").alias("key_mode"),
        "grid", "added_at")


def _fixed(value: Column, digits: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def collection_rows(rows: DataFrame, base_folder: str) -> DataFrame:
    """One TRACK struct per row, numbered from 1 in (added_at, id) order.

    The number is a distributed position, so a library of any size is numbered
    without a single-task window.
    """
    numbered = with_position(rows, [F.col("added_at"), F.col("id")], "_pos")
    grid = F.col("grid")
    g = with_segments(numbered.withColumns({"anchors": grid["anchors"]}))
    g = settle(g, _down=F.coalesce(first_beat_from(grid["first_downbeat_sec"] - 1e-6), F.lit(0).cast("bigint")))

    def nearest(t: Column) -> Column:
        at = F.coalesce(beat_at_or_before(t), F.lit(0).cast("bigint"))
        following = beat_time(at + 1)
        return F.when(F.coalesce(F.abs(following - t) < F.abs(beat_time(at) - t), F.lit(False)), at + 1).otherwise(at)

    per = grid["beats_per_bar"]
    tempos = F.transform("anchors", lambda a: F.struct(
        _fixed(a["time_sec"], 3).alias("_Inizio"), _fixed(a["bpm"], 2).alias("_Bpm"),
        F.concat(per.cast("string"), F.lit("/4")).alias("_Metro"),
        (F.pmod(nearest(a["time_sec"]) - F.col("_down"), per) + 1).cast("int").alias("_Battito")))
    cue = lambda name, t: F.struct(name.alias("name"), t.alias("time_sec"))
    cues = F.transform(F.coalesce("cues", F.array().cast("array<struct<id:string,name:string,time_sec:double>>")),
                       lambda c: cue(c["name"], c["time_sec"]))
    down = F.when(grid["first_downbeat_sec"] >= 0, F.array(cue(F.lit("Downbeat"), grid["first_downbeat_sec"]))).otherwise(
        F.array().cast("array<struct<name:string,time_sec:double>>"))
    marks = F.transform(F.filter(F.concat(down, cues), lambda c: (c["time_sec"] >= 0) & (c["time_sec"] < F.col("duration_sec"))),
                        lambda c: F.struct(c["name"].alias("_Name"), F.lit("0").alias("_Type"), _fixed(c["time_sec"], 3).alias("_Start"),
                                           F.lit("-1").alias("_Num")))
    none, blank = F.lit(0), F.lit("")
    path = F.coalesce("relative_path", "filename")
    attributes = {
        "TrackID": F.col("_pos") + 1, "Name": F.coalesce("title", "filename"), "Artist": F.coalesce("artist", blank), "Composer": blank,
        "Album": F.coalesce("album", blank), "Grouping": blank, "Genre": F.coalesce("genre", blank),
        "Kind": F.concat(F.upper(tx.extension(F.col("filename"))), F.lit(" File")), "Size": F.col("size_bytes"),
        "TotalTime": half_up(F.col("duration_sec")), "DiscNumber": none, "TrackNumber": F.coalesce("track_number", none),
        "Year": F.coalesce("year", none), "AverageBpm": F.coalesce(_fixed(F.col("bpm"), 2), F.lit("0.00")),
        "DateAdded": F.date_format(F.timestamp_millis(F.col("added_at")), "yyyy-MM-dd"), "BitRate": F.coalesce("bitrate_kbps", none),
        "SampleRate": F.coalesce("sample_rate", none), "Comments": F.coalesce("comment", blank), "PlayCount": none, "Rating": none,
        "Location": tx.location_url(F.lit(base_folder), path), "Remixer": blank,
        "Tonality": ks.tonality(F.col("key_tonic"), F.col("key_mode")), "Label": blank, "Mix": blank}
    return g.select(*[e.alias(f"_{n}") for n, e in attributes.items()],
                    F.coalesce(tempos, F.array().cast(f"array<{TEMPO}>")).alias("TEMPO"), marks.alias("POSITION_MARK"))


def write_collection_xml(rows: DataFrame, path: str, base_folder: str, playlist: str = "Export") -> None:
    """Write the collection and its playlist as XML parts.

    ``path/collection`` holds COLLECTION parts of TRACK elements, ``path/playlist``
    NODE parts of track keys and ``path/node`` the one NODE that names them.
    Each task writes its own part; nothing is assembled on the driver.
    """
    xml = collection_rows(rows, base_folder)

    def save(df: DataFrame, root: str, row: str, name: str) -> None:
        (df.write.format("xml").option("rootTag", root).option("rowTag", row).mode("overwrite").save(f"{path}/{name}"))

    save(xml, "COLLECTION", "TRACK", "collection")
    keys = xml.select(F.col("_TrackID").alias("_Key"))
    save(keys, "NODE", "TRACK", "playlist")
    save(keys.agg(F.count(F.lit(1)).alias("_Entries")).select(
        F.lit(playlist).alias("_Name"), F.lit(1).alias("_Type"), F.lit(0).alias("_KeyType"), "_Entries"), "PLAYLISTS", "NODE", "node")


def write_collection_document(rows: DataFrame, file: str, base_folder: str, playlist: str = "Export") -> None:
    """Write the collection and its playlist as one XML document, ``file``.

    Tasks write the elements as text parts in the order of the track numbers.
    The commit puts head, parts and tail together: by the store's own
    concatenation where it has one, else by one copy through a small buffer; no
    part is held as a whole. The document appears under its name by a rename.
    """
    spark = rows.sparkSession
    xml = collection_rows(rows, base_folder)
    parts = f"{file}.parts-{uuid.uuid4().hex}"
    ordered = xml.repartitionByRange("_TrackID").sortWithinPartitions("_TrackID")
    ordered.select(F.to_xml(F.struct(*xml.columns), {"rowTag": "TRACK"})).write.text(f"{parts}/tracks")
    n = rows.count()
    keys = spark.range(1, n + 1).select(F.format_string('<TRACK Key="%d"/>', F.col("id")))
    keys.write.text(f"{parts}/keys")
    # Elements and attributes of the format around the tracks.
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<DJ_PLAYLISTS Version="1.0.0">\n<COLLECTION Entries="{n}">\n'
    middle = (f'</COLLECTION>\n<PLAYLISTS>\n<NODE Type="0" Name="ROOT" Count="1">\n'
              f'<NODE Name={quoteattr(playlist)} Type="1" KeyType="0" Entries="{n}">\n')
    tail = "</NODE>\n</NODE>\n</PLAYLISTS>\n</DJ_PLAYLISTS>\n"
    _join_files(spark, [head, f"{parts}/tracks", middle, f"{parts}/keys", tail], parts, file)


def _join_files(spark: SparkSession, pieces: list[str], aside: str, file: str) -> None:
    """Texts, and the part files of the folders below ``aside``, one after the other in ``file``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(file).getFileSystem(spark._jsc.hadoopConfiguration())
    listed = []
    for k, piece in enumerate(pieces):
        if piece.startswith(aside):
            names = [s.getPath().getName() for s in fs.listStatus(path(piece))]
            listed += [f"{piece}/{n}" for n in sorted((n for n in names if n.startswith("part-")), key=_part_number)]
            continue
        out = fs.create(path(f"{aside}/text-{k}"), True)
        out.write(bytearray(piece.encode()))
        out.close()
        listed.append(f"{aside}/text-{k}")
    whole = path(listed[0])
    try:
        rest = spark.sparkContext._gateway.new_array(path, len(listed) - 1)
        for k, name in enumerate(listed[1:]):
            rest[k] = path(name)
        fs.concat(whole, rest)
    except UnsupportedOperationException:
        whole = path(f"{aside}/whole")
        out = fs.create(whole, True)
        for name in listed:
            source = fs.open(path(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(whole), fs.makeQualified(path(file)), kinds)
    fs.delete(path(aside), True)


def _part_number(name: str) -> tuple[int, str]:
    return int(name.split("-")[1].split(".")[0]), name


READ_SCHEMA = ("_TrackID bigint,_Name string,_Artist string,_AverageBpm double,_Tonality string,_Location string,"
               "TEMPO array<struct<_Inizio:double,_Bpm:double,_Metro:string,_Battito:int>>,"
               "POSITION_MARK array<struct<_Name:string,_Type:string,_Start:double,_Num:string>>")


def read_collection_xml(spark: SparkSession, path: str) -> DataFrame:
    """TRACK elements back to rows, with tempo and mark arrays; ``path`` is a folder of parts."""
    return _collection(spark, f"{path}/collection")


def read_collection_document(spark: SparkSession, file: str) -> DataFrame:
    """The same of one document; the playlist's TRACK elements have a key and no number."""
    return _collection(spark, file)


# A start tag that closes itself, from behind its name: quoted values may hold any character.
_CLOSED = """^(?:[^"'<>/]++|/(?!>)|"[^"]*+"|'[^']*+')*+/>"""


def _elements(spark: SparkSession, path: str) -> DataFrame | None:
    """TRACK elements of XML files as rows, files cut at the elements; None if comments or CDATA sections may hide some."""
    pieces = spark.read.option("lineSep", "<TRACK").text(path)
    if not pieces.where(F.col("value").contains("<!--") | F.col("value").contains("<![CDATA[")).isEmpty():
        return None
    closed = F.regexp_extract("value", _CLOSED, 0)
    inner = F.when(closed != "", closed).otherwise(F.concat(F.substring_index("value", "</TRACK", 1), F.lit("</TRACK>")))
    parsed = F.from_xml(F.concat(F.lit("<TRACK"), inner), READ_SCHEMA)
    # Read out of a generator, so that the filter on a field does not parse the element again.
    return pieces.where(F.col("value").rlike("^[\\s/>]")).select(F.inline(F.array(parsed)))


def _collection(spark: SparkSession, path: str) -> DataFrame:
    x = _elements(spark, path)
    if x is None:
        x = spark.read.format("xml").schema(READ_SCHEMA).option("rowTag", "TRACK").load(path)
    x = x.where("_TrackID is not null")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(x.schema[c].dataType))
    return x.select(F.col("_TrackID").alias("track_id"), F.col("_Name").alias("name"), F.coalesce("_Artist", F.lit("")).alias("artist"),
                    F.col("_AverageBpm").alias("average_bpm"), F.coalesce("_Tonality", F.lit("")).alias("tonality"),
                    F.col("_Location").alias("location"),
                    F.transform(empty("TEMPO"), lambda t: F.struct(
                        t["_Inizio"].alias("inizio"), t["_Bpm"].alias("bpm"), t["_Metro"].alias("metro"), t["_Battito"].alias("battito"))).alias("tempos"),
                    F.transform(empty("POSITION_MARK"), lambda m: F.struct(
                        m["_Name"].alias("name"), m["_Type"].alias("type"), m["_Start"].alias("start"), m["_Num"].alias("num"))).alias("marks"))


def m3u8_lines(rows: DataFrame, base_folder: str) -> DataFrame:
    """(playlist, line_no, line): a header, then two lines per track.

    ``rows``: playlist, pos, filename, relative_path, artist, title, duration_sec.
    """
    base = base_folder.rstrip("\\/")
    sep = "\\" if "\\" in base else "/"
    label = F.when((F.length("artist") > 0) & (F.length("title") > 0), F.concat_ws(" - ", "artist", "title")).otherwise(F.col("filename"))
    path = F.translate(F.coalesce("relative_path", "filename"), "\\/", sep * 2)
    body = rows.select("playlist", "pos", F.posexplode(F.array(
        F.concat(F.lit("#EXTINF:"), half_up(F.col("duration_sec")).cast("string"), F.lit(","), label),
        F.concat(F.lit(base + sep), path))).alias("_k", "line"))
    head = rows.select("playlist").distinct().select("playlist", F.lit(0).cast("bigint").alias("line_no"), F.lit("#EXTM3U").alias("line"))
    return head.unionByName(body.select("playlist", (F.col("pos") * 2 + F.col("_k") + 1).cast("bigint").alias("line_no"), "line"))


def write_m3u8(lines: DataFrame, path: str) -> None:
    """One folder per playlist; its part files in name order are the playlist."""
    (lines.repartitionByRange("playlist", "line_no").sortWithinPartitions("playlist", "line_no")
     .select("playlist", "line").write.partitionBy("playlist").mode("overwrite").text(path))


def read_m3u8(spark: SparkSession, path: str) -> DataFrame:
    """(playlist, duration_sec, label, path) of EXTINF/path line pairs.

    Lines are ordered by the number of their part file and their offset; the following line comes from a
    range-partitioned lead, so a playlist of any length is read in parallel.
    """
    lines = spark.read.text(path).select(
        "playlist", F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).try_cast("bigint").alias("_number"),
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    pairs = with_neighbour(lines, ["playlist"], ["_number", "_file", "_block", "_id"], {"line": "path"}, "next")
    meta = F.substr("line", F.lit(len("#EXTINF:") + 1))
    comma = F.instr(meta, ",")
    return (pairs.where(F.col("line").startswith("#EXTINF:") & (F.length("path") > 0) & ~F.col("path").startswith("#"))
            .select("playlist", F.when(comma > 0, F.substring_index(meta, ",", 1)).otherwise(meta).cast("double").alias("duration_sec"),
                    F.when(comma > 0, F.regexp_replace(meta, "^[^,]*,", "")).otherwise("").alias("label"), "path"))


def export_report(rows: DataFrame) -> DataFrame:
    """How many tracks carry a tempo, a key and a grid."""
    return rows.agg(F.count(F.lit(1)).alias("track_count"), F.count("bpm").alias("with_bpm"),
                    F.count("key_tonic").alias("with_key"), F.count("grid").alias("with_grid"))


def export_missing(rows: DataFrame) -> DataFrame:
    """(kind, id, filename) of what is missing, as rows: the lists can be as long as the library."""
    gaps = F.array_compact(F.array(F.when(F.col("bpm").isNull(), "bpm"), F.when(F.col("key_tonic").isNull(), "key"),
                                   F.when(F.col("grid").isNull(), "grid")))
    return rows.select("id", "filename", F.explode(gaps).alias("kind"))
