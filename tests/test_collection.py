"""One collection document against a standard XML parser, and line order by part numbers."""

import xml.etree.ElementTree as ET

from cratewise.plans import file_queries as fq
from cratewise.session import checkpoint_folder
from cratewise.sources import collection as co
from cratewise.sources.folders import scratch_folder


def test_a_standard_parser_reads_one_document(spark):
    rows = fq.rows(spark, "/root/testdata/sf0.001")
    file = f"{scratch_folder(spark, 'document')}.xml"
    for playlist in ("first", 'Set <1> & "more"'):  # the second replaces the first
        co.write_collection_document(rows, file, "/Music & more", playlist)
    root = ET.parse(file.removeprefix("file:")).getroot()
    assert root.tag == "DJ_PLAYLISTS" and [c.tag for c in root] == ["COLLECTION", "PLAYLISTS"]
    tracks = root.find("COLLECTION")
    n = rows.count()
    assert tracks.get("Entries") == str(n) and [int(t.get("TrackID")) for t in tracks] == list(range(1, n + 1))
    node = root.find("PLAYLISTS/NODE/NODE")
    assert node.get("Name") == 'Set <1> & "more"' and node.get("Entries") == str(n)
    assert sorted(int(t.get("Key")) for t in node) == list(range(1, n + 1))
    assert any(t.find("TEMPO") is not None for t in tracks) and any(t.find("POSITION_MARK") is not None for t in tracks)
    back = co.read_collection_document(spark, file)
    assert back.count() == n and back.agg({"track_id": "max"}).first()[0] == n


def test_lines_follow_the_numbers_of_their_parts(spark):
    from pathlib import Path

    folder = scratch_folder(spark, "many-parts")
    place = Path(folder.removeprefix("file:")) / "playlist=1"
    place.mkdir(parents=True)
    pieces = ["#EXTM3U", "#EXTINF:1,a - b", "/one", "#EXTINF:2,c", "/two"]
    for number, line in zip((0, 99_998, 99_999, 100_000, 100_001), pieces):
        (place / f"part-{number:05d}-x.txt").write_text(line + "\n")
    rows = co.read_m3u8(spark, folder).orderBy("duration_sec").collect()
    assert [(r["duration_sec"], r["label"], r["path"]) for r in rows] == [(1.0, "a - b", "/one"), (2.0, "c", "/two")]
    assert checkpoint_folder(spark)


def test_a_document_is_read_in_parts(spark):
    body = "".join(f'<TRACK TrackID="{i}" Name="a/&gt; > b {i}" Artist=\'"/>\'{"/>" if i % 2 else f"><TEMPO Inizio=" + chr(34) + "0.5" + chr(34) + "/></TRACK>"}\n'
                   for i in range(1, 2001))
    text = f'<?xml version="1.0"?>\n<COLLECTION Entries="2000">\n{body}</COLLECTION>\n<PLAYLISTS><TRACK Key="1"/><TRACKS TrackID="0"/></PLAYLISTS>\n'
    folder = scratch_folder(spark, "parts")
    file = f"{folder.removeprefix('file:')}.xml"
    with open(file, "w") as f:
        f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        tracks = co.read_collection_document(spark, file)
        assert tracks.rdd.getNumPartitions() > 4
        rows = {r["track_id"]: r for r in tracks.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == list(range(1, 2001))
    assert all(r["name"] == f"a/> > b {i}" and r["artist"] == '"/>' and len(r["tempos"]) == 1 - i % 2 for i, r in rows.items())
    # what a comment hides is no track
    with open(file, "w") as f:
        f.write(text.replace('<PLAYLISTS>', '<!-- <TRACK TrackID="7777"/> --><PLAYLISTS>'))
    assert co.read_collection_document(spark, file).where("track_id = 7777").count() == 0
