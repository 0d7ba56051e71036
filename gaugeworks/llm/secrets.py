"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern, as spans of code points. The value of each is hashed where it is found, so that no value is
written in clear, and the hashes are aggregated over the whole corpus by distinct repositories and owners. A value that
several owners or many repositories hold is an example that was copied around; a value of one owner in few repositories
that also looks random is likely a live credential, and gets a span of kind ``live`` beside the base spans.

Where no column names the repository, each distinct text is one, so that copies of a text count once. A value of one text
alone stays its owner's if that text was copied to one other owner; any other value of two owners is unsettled.

Null texts count as empty. Rows with equal id and text have equal results. Null owners count as one owner, null
repositories as one repository. Column names other than those named in the arguments don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._io import written
from gaugeworks.llm._joins import split_join

#: Kind, pattern, group that holds the secret value, least code points of that group; in the order of the result.
KINDS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
)
#: Candidates of the method alone: long runs, and the signs that each of them mixes. They get no span unless they are live.
MIXED, MIXTURE = r"([A-Za-z0-9+/_-]{20,})", ("[0-9]", "[A-Z]", "[a-z]")
PLACEHOLDER = "example|sample|dummy|test|changeme|placeholder|your|xxxx|0123|1234|abcd"
#: Owners, and repositories, from which a value is a copied example; distinct signs that a live value has at least.
WIDELY_COPIED, MANY_REPOSITORIES, LIVE_SIGNS = 3, 10, 8
#: Matches whose places are added up together at least.
CHUNK = 32


def _let(value: Column, of) -> Column:
    """``of`` a value that is computed once, however often it is named."""
    return F.transform(F.array(value), of)[0]


def _chunked(items: Column, power: float, of) -> Column:
    """``of`` the items in chunks whose size is a power of their number, ``CHUNK`` at least."""

    def cut(x: Column) -> Column:
        size = F.greatest(F.lit(CHUNK), F.ceil(F.pow(F.size(x), F.lit(power)))).cast("int")
        return _let(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / n).cast("int"))), lambda k: F.slice(x, k * n + 1, n)))

    return _let(items, lambda x: _let(cut(x), of))


def _running(items: Column, first: Column, empty: Column, width, make) -> Column:
    """``make`` of each item and the sum of the widths before it, from ``first`` on. An array grows by copying: keep ``items`` short."""
    return F.aggregate(
        items,
        F.struct(first.alias("at"), empty.alias("out")),
        lambda acc, x: F.struct((acc["at"] + width(x)).alias("at"), F.concat(acc["out"], F.array(make(acc["at"], x))).alias("out")),
        lambda acc: acc["out"],
    )


def _placed(items: Column, empty: Column, width, make) -> Column:
    """As :func:`_running` for any number of items: by chunks, whose own places come from chunks of chunks."""
    none = F.array().cast("array<int>")
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    along = lambda part, first: _running(part, first, none, lambda x: x, lambda at, x: at)

    def starts(chunks: Column) -> Column:
        widths = F.transform(chunks, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + width(x)))
        return _chunked(widths, 1 / 2, lambda outer: F.flatten(F.zip_with(outer, along(F.transform(outer, total), F.lit(0)), along)))

    return _chunked(items, 1 / 3, lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), lambda part, first: _running(part, first, empty, width, make))))


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, start, end, value): the leftmost non-overlapping matches whose group has ``least`` code points.

    Matches and the gaps between them alternate, so that running sums of their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.filter(F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("size"), values.alias("value")), lambda x: x["size"].isNotNull())
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,value:string>>")
    placed = _placed(
        zipped,
        none,
        lambda x: x["gap"] + x["size"],
        lambda at, x: F.struct(F.lit(kind).alias("kind"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), F.filter(placed, lambda x: F.length(x["value"]) >= least)).otherwise(none)


def looks_live(value: Column) -> Column:
    """Whether a value has digits, letters and many different signs, and no placeholder's words."""
    signs = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (signs >= LIVE_SIGNS) & ~F.lower(value).rlike(PLACEHOLDER)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, owner, repository, two hashes of the text, and ``found``, its candidates in order of start and kind.

    A candidate has its place, where its value begins, the value's hash and whether it looks live, but not the value.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def ranked(rank: int, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"),
                (x["end"] - F.length(x["value"])).alias("value_start"), F.sha2(x["value"], 256).alias("value_hash"), looks_live(x["value"]).alias("live"),
            ),
        )

    mixed = F.filter(spans_of(t, "live", MIXED, 1, 20), lambda x: x["value"].rlike(MIXTURE[0]) & x["value"].rlike(MIXTURE[1]) & x["value"].rlike(MIXTURE[2]))
    arrays = [ranked(k, spans) for k, spans in enumerate((*[spans_of(t, *kind) for kind in KINDS], mixed))]
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(owner).cast("string").alias("owner"),
        (F.col(repository).cast("string") if repository else F.hex(F.xxhash64(t))).alias("repository"),
        F.xxhash64(t).alias("text_hash"),
        F.xxhash64(F.lit(1), t).alias("text_more"),
        F.array_sort(F.concat(*arrays)).alias("found"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate value's hash: distinct owners, repositories and texts, candidates, whether it looks live, and its class.

    The counts are distinct ones, which Spark takes apart by (value, owner), (value, repository) and (value, text) and adds
    up before the shuffle by value, so that a value that a third of all rows hold doesn't gather in one task.
    """
    none = F.lit("\0")  # null is one owner or repository
    each = found.select(F.coalesce("owner", none).alias("o"), F.coalesce("repository", none).alias("r"), "text_hash", F.explode("found").alias("x"))
    by_value = each.groupBy(F.col("x.value_hash").alias("value_hash")).agg(
        F.countDistinct("o").alias("n_owners"), F.countDistinct("r").alias("n_repositories"), F.countDistinct("text_hash").alias("n_texts"), F.count(F.lit(1)).alias("n_candidates"), F.max("x.live").alias("live")
    )
    copied = (F.col("n_owners") >= WIDELY_COPIED) | (F.col("n_repositories") >= MANY_REPOSITORIES)
    own = (F.col("n_owners") == 1) | ((F.col("n_owners") == 2) & (F.col("n_texts") == 1))
    return by_value.withColumn("class", F.when(copied, "example").when(own & F.col("live"), "live").otherwise("unsettled"))


def joined_spans(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """id, owner, ``base`` (spans by pattern) and ``live`` (spans of values that the corpus shows to be one owner's own).

    Documents without candidates, and those whose candidates are all copied, have empty arrays. Live spans are found once
    for each distinct text, in which a live value occurs in few, and then given to the text's copies.
    """
    found = written(scan(docs, id_col, text, owner, repository), "secrets")
    live = ownership(found).where("class = 'live'").select("value_hash")
    texts = ["text_hash", "text_more"]
    # the value's own place: it ends its match
    span = F.struct(F.col("x.value_start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("x.end").alias("end"), F.lit("live").alias("kind"))
    each = found.where(F.size("found") > 0).select(*texts, F.explode("found").alias("x")).select(*texts, F.col("x.value_hash").alias("value_hash"), span.alias("span")).distinct()
    lives = each.join(live, "value_hash").groupBy(*texts).agg(F.array_sort(F.collect_set("span")).alias("live"))
    base = F.filter("found", lambda x: x["rank"] < len(KINDS))
    rows = found.select("id", "owner", *texts, F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("base"))
    out = split_join(rows, lives, texts, "left")
    return out.select(F.col("id").alias(id_col), F.col("owner"), "base", F.coalesce("live", F.filter("base", lambda x: F.lit(False))).alias("live"))
