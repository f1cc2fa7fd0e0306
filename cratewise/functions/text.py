"""Text columns of the catalogue: names, search blobs, tokens, file URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words too common to narrow a search.
COMMON_WORDS = ["artist", "title", "album", "recording", "song", "track",
                "wav", "mp3", "flac", "aac", "m4a"]


def tidy(value: Column) -> Column:
    """Collapse whitespace, trim, and turn an empty string into NULL."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def display_name(artist: Column, title: Column, filename: Column) -> Column:
    has_artist = F.length(artist) > 0
    has_title = F.length(title) > 0
    return (F.when(has_artist & has_title, F.concat(artist, F.lit(" — "), title))
            .when(has_title, title)
            .otherwise(F.regexp_replace(filename, r"\.[^.]+$", "")))


def search_blob(name: Column, artist: Column, title: Column, album: Column) -> Column:
    empty = F.lit("")
    return F.lower(F.concat_ws(" ", name, F.coalesce(artist, empty),
                               F.coalesce(title, empty), F.coalesce(album, empty)))


def words(text: Column) -> Column:
    """Lower-case alphanumeric runs in order, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def search_tokens(text: Column) -> Column:
    """Distinct words, then distinct adjacent pairs of the raw word list."""
    def both(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                           F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.concat(w, pairs))
    # The one-element array binds the word list, so the split runs once per row.
    return F.get(F.transform(F.array(words(text)), both), F.lit(0))


def pick_token(tokens: Column) -> Column:
    """Most selective word: not common, digits first, then the longest, first wins."""
    ranked = F.transform(tokens, lambda t, i: F.struct(
        t.isin(COMMON_WORDS).cast("int").alias("common"),
        (~t.rlike("^[0-9]+$")).cast("int").alias("texty"),
        (-F.length(t)).alias("len"), i.alias("i"), t.alias("word")))
    return F.array_min(ranked)["word"]


def basename(path: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    return F.when(F.length(last) > 0, last).otherwise(path)


def extension(name: Column) -> Column:
    return F.element_at(F.split(F.lower(name), r"\."), -1)


def location_url(base_folder: Column, filename: Column) -> Column:
    """``file://localhost`` URL with each path segment percent-encoded.

    The built-in encoder is form encoding, so the characters on which it
    differs from URI component encoding are put back.
    """
    base = F.regexp_replace(F.regexp_replace(base_folder, r"\\", "/"), "/+$", "")
    rooted = F.when(base.rlike("^[A-Za-z]:"), F.concat(F.lit("/"), base)).otherwise(base)
    full = F.concat(rooted, F.lit("/"), filename)

    def encode(segment: Column) -> Column:
        out = F.url_encode(segment)
        for coded, plain in (("\\+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"),
                             ("%28", "("), ("%29", ")"), ("%3A", ":")):
            out = F.regexp_replace(out, coded, plain)
        return out

    encoded = F.array_join(F.transform(F.split(full, "/"), encode), "/")
    return F.concat(F.lit("file://localhost"),
                    F.when(encoded.startswith("/"), "").otherwise("/"), encoded)
