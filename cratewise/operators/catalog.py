"""Catalogue projection, search, filter, sort and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cratewise.functions import text as tx
from cratewise.operators.edits import effective_bpm
from cratewise.operators.ordered import with_position
from cratewise.operators.review import is_stale, needs_review
from cratewise.operators.token_runs import ranged_rows, same_order
from cratewise.schemas import ANALYSIS_VERSION

# Rows up to which a page is read by top-k from one end; beyond that the page
# is cut out of a distributed numbering instead of a growing heap per task.
TOP_K_LIMIT = 10_000


def project_catalog(tracks: DataFrame) -> DataFrame:
    """Light metadata row: whitelisted columns, nested values cut to what lists show.

    The analysis is kept only when tempo, key and grid are all present. Every
    field is a plain struct path, so nested column pruning reaches the scan.
    """
    a = F.col("analysis")
    label = F.get(a["structure"]["sections"], F.lit(0))["label"]
    light = F.when(
        a["tempo"].isNotNull() & a["key"].isNotNull() & a["grid"].isNotNull(),
        F.struct(F.struct(a["tempo"]["bpm"].alias("bpm")).alias("tempo"),
                 F.struct(a["key"]["tonic"].alias("tonic"), a["key"]["mode"].alias("mode")).alias("key"),
                 a["grid"].alias("grid"),
                 F.struct(a["energy"]["level"].alias("level"),
                          a["energy"]["raw_score"].alias("raw_score")).alias("energy"),
                 a["vocal_coverage"].alias("vocal_coverage"), label.alias("first_section")))
    return tracks.select(
        "id", "name", "content_hash", "audio_hash", "relative_path", "file_path", "mime_type",
        "size_bytes", "duration_sec", F.coalesce("added_at", F.lit(0)).alias("added_at"), "tags",
        "analysis_version", "analysis_error", "manual_bpm", "manual_grid", "manual_key_tonic",
        "manual_key_mode", "reviewed_at", "grid_locked", "cues", "has_fingerprint",
        light.alias("analysis"))


def catalog_keys(tracks: DataFrame, current_version: int = ANALYSIS_VERSION,
                 stale_analyzers: DataFrame | None = None) -> DataFrame:
    """Compact key row of a track: search text, tokens, sort values and flags."""
    if stale_analyzers is not None:
        stale = stale_analyzers.select(F.col("track_id").alias("id"), F.lit(True).alias("_old")).distinct()
        tracks = tracks.join(stale, "id", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
        outdated: Column | None = F.col("_old")
    else:
        outdated = None
    tags = F.col("tags")
    blob = tx.search_blob(F.col("name"), tags["artist"], tags["title"], tags["album"])
    full = (F.col("analysis.tempo").isNotNull() & F.col("analysis.key").isNotNull()
            & F.col("analysis.grid").isNotNull())
    return tracks.select(
        "id", tx.display_name(tags["artist"], tags["title"], F.col("name")).alias("name"),
        F.coalesce(effective_bpm(), F.lit(0.0)).alias("bpm"), blob.alias("search"),
        tx.search_tokens(blob).alias("tokens"), F.coalesce("added_at", F.lit(0)).alias("added_at"),
        (F.col("reviewed_at").isNull() & (~F.coalesce(full, F.lit(False)) | needs_review(current_version, outdated))).alias("review"),
        (F.length(F.col("analysis_error")) > 0).alias("_f"),
        F.col("reviewed_at").isNotNull().alias("reviewed"),
        is_stale(current_version, outdated).alias("stale"),
    ).withColumn("failed", F.coalesce("_f", F.lit(False))).drop("_f")


def search_contains(keys: DataFrame, text: str) -> DataFrame:
    needle = text.strip().lower()
    return keys.where(F.col("search").contains(needle)) if needle else keys


def search_token_prefix(keys: DataFrame, text: str) -> DataFrame:
    """Index-style search: a token prefix picks candidates, the text filters them.

    With two words or more the prefix is the first two distinct words, else the
    most selective word. ``exists`` over the token array is a row-local test, so
    no candidate list is shuffled.
    """
    from cratewise.operators.search_index import search_prefix

    prefix = search_prefix(text)
    if not prefix:
        return search_contains(keys, text)
    return search_contains(keys.where(F.exists("tokens", lambda t: t.startswith(prefix))), text)


def token_index(keys: DataFrame) -> DataFrame:
    """(token, id) rows, range-clustered by token: prefix scans prune by file statistics.

    Tokens are made once: a task sorts those it makes, and compressed slices of
    its runs are dealt to the ranges. Equal rows stay, keys without tokens go.
    Ids of a type that only Spark sorts (nested, floating or collated) go as
    plain rows, after an exchange of whole key rows that both the pass for bounds
    and the one that deals rows read; an outer explode keeps the planner from
    testing the size of the tokens below it, which makes them once more.
    """
    if same_order(keys):
        return ranged_rows(keys)
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.select("id", "tokens").repartition(tasks).select(F.posexplode_outer("tokens").alias("_at", "token"), "id")
    return (rows.where("_at is not null").select("token", "id")
            .repartitionByRange("token", "id").sortWithinPartitions("token", "id"))


def filter_flag(keys: DataFrame, flag: str) -> DataFrame:
    return keys if flag == "all" else keys.where(F.col(flag))


def sort_order(sort: str, reverse: bool = False) -> list[Column]:
    if sort == "name":
        cols = [(F.collate(F.col("name"), "UNICODE"), True), (F.col("id"), True)]
    elif sort == "bpm":
        cols = [(F.col("bpm"), True), (F.col("id"), True)]
    else:
        cols = [(F.col("added_at"), False), (F.col("id"), False)]
    return [c.asc() if up != reverse else c.desc() for c, up in cols]


def matching(keys: DataFrame, text: str = "", flag: str = "all", sort: str = "added") -> DataFrame:
    """Every match in order; the filter runs before the sort."""
    return filter_flag(search_contains(keys, text), flag).orderBy(*sort_order(sort))


def page_offset(keys: DataFrame, text: str = "", flag: str = "all", sort: str = "added",
                offset: int = 0, limit: int = 100) -> DataFrame:
    """One page with the total; the offset is clamped to the start of the last page."""
    size = max(1, min(200, int(limit)))
    found = filter_flag(search_contains(keys, text), flag)
    total = found.count()
    start = min(max(0, int(offset)), max(0, (total - 1) // size * size))
    take = min(size, max(0, total - start))
    if start + take <= TOP_K_LIMIT:
        page = found.orderBy(*sort_order(sort)).offset(start).limit(take)
    elif total - start <= TOP_K_LIMIT:
        page = page_from_tail(found, sort, total, start, take)
    else:
        numbered = with_position(found, sort_order(sort), "_pos")
        page = numbered.where(F.col("_pos").between(start, start + take - 1)).drop("_pos").orderBy(*sort_order(sort))
    return page.withColumns({"total": F.lit(total).cast("bigint"), "offset": F.lit(start).cast("bigint")})


def page_from_tail(keys: DataFrame, sort: str, total: int, start: int, take: int) -> DataFrame:
    """Deep jump: read from the nearer end, then put the page back in order."""
    from_end = max(0, total - start - take)
    tail = keys.orderBy(*sort_order(sort, reverse=True)).offset(from_end).limit(take)
    return tail.orderBy(*sort_order(sort))


def page_keyset(keys: DataFrame, sort: str, after: tuple, limit: int = 100) -> DataFrame:
    """Next page after (sort value, id): a pushed-down range filter and a top-k."""
    value, last = after
    column = "bpm" if sort == "bpm" else "name" if sort == "name" else "added_at"
    key = F.collate(F.col(column), "UNICODE") if sort == "name" else F.col(column)
    edge = F.collate(F.lit(value), "UNICODE") if sort == "name" else F.lit(value)
    if sort == "added":
        rest = (key < edge) | ((key == edge) & (F.col("id") < last))
    else:
        rest = (key > edge) | ((key == edge) & (F.col("id") > last))
    return keys.where(rest).orderBy(*sort_order(sort)).limit(limit)


def hydrate(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Metadata for (pos, id) rows; unknown ids drop out, ``pos`` keeps the order."""
    return ids.join(catalog, "id").orderBy("pos")


def catalog_stats(tracks: DataFrame, keys: DataFrame) -> DataFrame:
    """Total, indexed, stale and review counts in one row."""
    return (tracks.select(F.lit("track").alias("side"), F.lit(False).alias("stale"), F.lit(False).alias("review"))
            .unionByName(keys.select(F.lit("key").alias("side"), "stale", "review"))
            .agg(F.count_if(F.col("side") == "track").alias("total"),
                 F.count_if(F.col("side") == "key").alias("indexed"),
                 F.count_if("stale").alias("stale"), F.count_if("review").alias("review"))
            .withColumn("complete", F.col("total") == F.col("indexed")))


def missing_path_rows(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose stored path is set but is not in the folder listing."""
    return (tracks.where(F.length("file_path") > 0)
            .join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti"))
