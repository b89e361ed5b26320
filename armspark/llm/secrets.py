"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Three fixed kinds of secret are found by pattern in every whole text, and a generic kind of candidate:
long runs of credential characters. Every candidate's hash is counted over the corpus by distinct
repositories and distinct owners. A value that several owners hold is a widely copied example; a
value of one owner that mixes letters and digits is a live-looking credential. Generic candidates become spans only
when they are live-looking; spans of the fixed kinds always stay, with their class beside them.

Positions come from the matches alone: each match also takes the text since the last match, so running sums of
lengths are code-point offsets. The counts aggregate (hash, repository) and (hash, owner) first, so that one value
in a third of all rows is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import row_key, whole_text

# The patterns of the contract. Shorter runs of the last two kinds would be dropped, so the length is in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
GENERIC = r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-]))"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "generic": GENERIC}
# What every match must hold: cheap to test, and most texts stop there.
SCREENS = {
    "assign": lambda text: text.contains("=") | text.contains(":"),
    "access": lambda text: text.contains("AKIA"),
    "hex": lambda text: text.rlike("[0-9a-f]{24}"),
    "generic": lambda text: text.rlike("[A-Za-z0-9+/_-]{20}"),
}
MIN_ASSIGNED = 6
WIDE_OWNERS = 3  # this many distinct owners make a value a copied example

_SPAN = "struct<s:int,e:int,kind:string,value:string>"


def _spans(text: Column, kind: str) -> Column:
    """Array of (s, e, kind, value) of all leftmost matches; ``\\G`` keeps the search from starting over.

    One scan per kind cuts the text into pieces of gap and match. Texts that cannot match skip it.
    """
    pattern, screen = KINDS[kind], SCREENS[kind]
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?{pattern}"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        e = state["at"] + F.char_length(piece)
        hit = F.regexp_extract(piece, rf"(?s)\A.*?({pattern})\z", 1)
        value = F.regexp_extract(piece, rf"(?s)\A.*?{pattern}\z", 1)
        span = F.struct((e - F.char_length(hit)).alias("s"), e.alias("e"), F.lit(kind).alias("kind"), value.alias("value"))
        return F.struct(e.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    return F.when(screen(text), F.aggregate(pieces, start, step)["found"]).otherwise(start["found"])


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"), F.array_position(order, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind")
        ),
    )
    return F.array_join(
        F.transform(F.array_sort(ranked), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per document: fixed spans and generic candidates with their values; no text."""
    text = whole_text()
    assign = F.filter(_spans(text, "assign"), lambda x: F.char_length(x["value"]) >= MIN_ASSIGNED)
    base = F.concat(assign, _spans(text, "access"), _spans(text, "hex"))
    mixed = F.filter(
        _spans(text, "generic"), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    )
    return docs.select(
        F.col("doc_id"), repository.alias("repository"), owner.alias("owner"), base.alias("base"), mixed.alias("generic")
    )


def ownership(found: DataFrame) -> DataFrame:
    """(digest, repositories, owners) of each candidate value over the whole corpus."""
    sides = []
    for side in ("repository", "owner"):
        pairs = found.groupBy("digest", F.lit(side).alias("side"), F.col(side).alias("who")).agg(F.lit(1).alias("one"))
        sides.append(pairs)
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy("digest")
        .agg(F.count_if(F.col("side") == "repository").alias("repositories"), F.count_if(F.col("side") == "owner").alias("owners"))
    )


def secret_spans(
    docs: DataFrame,
    repository: Column | None = None,
    owner: Column | None = None,
    wide_owners: int = WIDE_OWNERS,
) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live, values.

    repository, owner: who holds the document; by default the pair of source and language, and the source.
    ``values`` lists (s, e, kind, digest, repositories, owners, class) with class ``copied``, ``live`` or ``unclear``.

    NULL or empty text: no spans, the digest of the empty text. NULL ids, repositories and owners are values of
    their own. Repeated rows are reported each and hold their values once per owner. Other columns are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if repository is None else repository
    held = materialize(row_key(candidates(docs, repository, owner), "row"), "secret-spans")
    every = held.select("row", "repository", "owner", F.inline(F.concat("base", "generic"))).withColumn(
        "digest", F.sha2("value", 256)
    )
    counted = materialize(ownership(every), "secret-owners")
    looks = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    label = (
        F.when(F.col("owners") >= wide_owners, "copied").when((F.col("owners") == 1) & looks, "live").otherwise("unclear")
    )
    known = every.join(counted, "digest").withColumn("class", label)
    per_row = known.groupBy("row").agg(
        F.collect_list(F.struct("s", "e", "kind", "digest", "repositories", "owners", "class")).alias("values")
    )
    base = F.col("base")
    joined = held.join(per_row, "row", "left").withColumn(
        "values", F.coalesce("values", F.array().cast(per_row.schema["values"].dataType))
    )

    def n(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    # A generic run inside a fixed span is the same secret and adds nothing.
    added = F.filter(
        F.col("values"),
        lambda x: (x["kind"] == "generic")
        & (x["class"] == "live")
        & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])),
    )
    spans = F.concat(
        F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))),
        F.transform(added, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))),
    )
    return joined.select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        F.size(F.filter("values", lambda x: x["class"] == "copied")).cast("long").alias("n_copied"),
        F.size(F.filter("values", lambda x: x["class"] == "live")).cast("long").alias("n_live"),
        F.array_sort("values").alias("values"),
    )
