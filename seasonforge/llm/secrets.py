"""Secret scans with multipart credential linking (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")

# Weak parts: each is harmless alone.  A client or user name, an unlabelled key-like word, an address.
LOGIN = r"""\b(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
KEYLIKE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+"
ENDPOINT = r"\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@%&=+-]{4,}"

#: Matches whose places are added up at once.
BLOCK = 128
#: A weak part needs a complement whose start is at most so many code points away in the same document.
SCOPE = 400


def _pieces(text: Column, pattern: str) -> Column:
    """The gaps between leftmost non-overlapping matches of ``pattern`` and the matches, alternating; the last gap has none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
    return F.when(text.rlike(pattern), pieces).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))


def _blocks(pieces: str) -> Column:
    """The pieces in blocks of BLOCK."""
    last = F.floor((F.greatest(F.size(pieces), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(pieces, b * BLOCK + 1, BLOCK))


def _spans(blocks: str, kind: str, keep) -> Column:
    """The matches that ``keep`` keeps by their text, as array<struct<start, end, kind>>, in code points.

    Starts are running sums of the pieces' lengths: over blocks first, then within each block, so that a text
    with very many matches takes no quadratic time.
    """
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    ints, none = F.array().cast("array<int>"), F.array().cast("array<struct<start:int,end:int,kind:string>>")
    starts = F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), ints.alias("out")),
        lambda s, b: F.struct((s["at"] + F.aggregate(b, F.lit(0), lambda a, x: a + size(x))).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )

    def within(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("at"), none.alias("out")),
            lambda s, x: F.struct(
                (s["at"] + size(x)).alias("at"),
                F.when(
                    x["hit"].isNotNull() & F.coalesce(keep(x["hit"]), F.lit(False)),
                    F.concat(s["out"], F.array(F.struct(
                        (s["at"] + F.length(x["gap"])).alias("start"),
                        (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
                        F.lit(kind).alias("kind"),
                    ))),
                ).otherwise(s["out"]).alias("out"),
            ),
            lambda s: s["out"],
        )

    return F.flatten(F.zip_with(blocks, starts, within))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate((*KINDS, "login", "key", "endpoint")) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda x: F.struct(x["start"], order[x["kind"]].alias("rank"), x["end"], x["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets per row: ``doc_id, base, linked`` as arrays of (start, end, kind), offsets in code points.

    ``base`` are the spans of the three strong kinds.  ``linked`` are weak parts (``login``, ``key``,
    ``endpoint``) that overlap no base span and have a complement in scope: a key needs an access
    identifier, a login or an endpoint; a login needs a key or a labelled value; an endpoint needs a key, a
    labelled value or an access identifier.  The interval join is an equality join on (document, cell of
    ``scope`` code points): the part side is expanded to its own and both neighbouring cells, the
    complement side is first reduced to its smallest and largest start per cell and kind, so crowded
    scopes don't multiply.

    A null text is empty and gives empty arrays; repeated rows give repeated results; spans with the same
    start are ordered by kind; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    long6 = lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6
    any_ = lambda m: F.lit(True)
    # a digit with letters of both cases, or with letters of one case and no other sign (base32, for one)
    mixed = lambda m: m.rlike("[0-9]") & (m.rlike("[a-z]") & m.rlike("[A-Z]") | m.rlike("[A-Za-z]") & ~m.rlike("[+/]"))
    at_least = lambda n: lambda m: F.length(m) >= n
    wanted = {"assign": (ASSIGN, long6), "access": (ACCESS, at_least(20)), "hex": (HEX, at_least(24)), "login": (LOGIN, any_), "key": (KEYLIKE, mixed), "endpoint": (ENDPOINT, any_)}
    pieces = {k: _pieces(text, p) for k, (p, _) in wanted.items()}
    pieces["hex"] = F.when(text.rlike("[0-9a-f]{24}"), pieces["hex"]).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), *[c.alias(k) for k, c in pieces.items()])
    rows = rows.select("doc_id", "text_key", *[_blocks(k).alias(k) for k in wanted])
    spans = {k: _spans(k, k, keep) for k, (_, keep) in wanted.items()}
    rows = cut(rows.select("doc_id", "text_key", F.concat(*[spans[k] for k in KINDS]).alias("base"), F.concat(*[c for k, c in spans.items() if k not in KINDS]).alias("weak")))

    both = rows.where("size(weak) > 0 and size(weak) + size(base) > 1").select("doc_id", "text_key", "base", "weak").distinct()
    strong, weak = (both.select("doc_id", "text_key", F.inline(c)) for c in ("base", "weak"))
    spread = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)))  # the cells of a span
    w, b = weak.withColumn("cell", spread).alias("w"), strong.withColumn("cell", spread).alias("b")
    same = [F.col("w.doc_id").eqNullSafe(F.col("b.doc_id")), *[F.col(f"w.{c}") == F.col(f"b.{c}") for c in ("text_key", "cell")]]
    covered = w.join(b, same).where((F.col("w.start") < F.col("b.end")) & (F.col("b.start") < F.col("w.end"))).select("w.doc_id", "w.text_key", "w.start", "w.kind").distinct()
    v, c = weak.alias("v"), covered.alias("c")
    free = v.join(c, [F.col("v.doc_id").eqNullSafe(F.col("c.doc_id")), *[F.col(f"v.{k}") == F.col(f"c.{k}") for k in ("text_key", "start", "kind")]], "left_anti")
    parts = strong.unionByName(free).withColumn("cell", F.floor(F.col("start") / scope))
    ends = parts.groupBy("doc_id", "text_key", "cell", F.col("kind").alias("with")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    pairs = F.create_map(
        F.lit("key"), F.array(F.lit("access"), F.lit("login"), F.lit("endpoint")),
        F.lit("login"), F.array(F.lit("key"), F.lit("assign"), F.lit("hex")),
        F.lit("endpoint"), F.array(F.lit("key"), F.lit("assign"), F.lit("access")),
    )
    asks = (
        parts.where(F.col("kind").isin("key", "login", "endpoint"))
        .withColumn("with", F.explode(pairs[F.col("kind")]))
        .withColumn("cell", F.explode(F.array(*[F.col("cell") + i for i in (-1, 0, 1)])))
    )
    near = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope)
    same = ["cell", "with", "text_key"]
    a, e = asks.alias("a"), ends.alias("e")
    joined = a.join(e, [F.col("a.doc_id").eqNullSafe(F.col("e.doc_id")), *[F.col(f"a.{c}") == F.col(f"e.{c}") for c in same]])
    linked = (
        joined.where(near).select("a.doc_id", "a.text_key", "start", "end", "kind").distinct()
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("linked"))
    )
    r, k = rows.alias("r"), linked.alias("k")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return r.join(k, [F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")), F.col("r.text_key") == F.col("k.text_key")], "left").select("r.doc_id", "base", F.coalesce("linked", none).alias("linked"))


def secret_digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text, per row."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return find_secrets(docs, scope).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"),
    )
