r"""Secrets in texts, told from widely copied examples by who owns them. DataFrame functions only.

Each text is searched where it lies. Three base kinds are reported wherever they match: an assignment
of eight characters or more to a telling name, an access key id, a run of hex digits. What else has a
credential's shape (`MORE`: private keys, signed tokens, vendors' keys, logins in addresses, opaque
runs) is a candidate outside of base spans. Values are hashed, and over the whole corpus each hash is
counted by distinct repositories and distinct owners: a value of `EXAMPLE_OWNERS` owners or more is an
example that is copied around; one of fewer owners that looks live (`looks_live`) is a live credential.
Base spans stay whatever their verdict; a candidate becomes a span only if it is live.

Texts are never shuffled: rows keep spans and hashes. (hash, owner, repository) are counted once each in
two steps with partial sums, so a value that stands in every document is no hot key. Verdicts meet the
spans of distinct texts, then the rows; copies beyond a partition are split by Spark's skew join.

Places are code points, ends exclusive. Defined cases: a null text is empty and has no spans. A null
owner is one owner without a name, a null repository one repository of its owner. Null and repeated
doc_ids are rows of their own; copies of a text get equal spans. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Patterns of the base kinds.
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Least characters of an assigned value.
ASSIGNED = 8
# Shapes of other credentials, the first that fits names the kind.
MORE = {
    "pem": r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]{32,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "vendor": r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{16,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,}|npm_[A-Za-z0-9]{36,})",
    "login": r"://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+!~*-]{6,64}@",
    "opaque": r"[A-Za-z0-9]{24,}",
}
KINDS = ("assign", "access", "hex", *MORE)
CANDIDATE = "|".join(MORE.values())
#: A value that so many owners have is an example.
EXAMPLE_OWNERS = 3
# What shows that a value stands for one.
PLACEHOLDER = r"[eE][xX][aA][mM][pP][lL][eE]|EXAMPLE|[sS][aA][mM][pP][lL][eE]|[dD][uU][mM][mM][yY]|[pP][lL][aA][cC][eE][hH][oO][lL][dD]|[cC][hH][aA][nN][gG][eE]_?[mM][eE]|[xX]{4}|\*{3}|123456789|0{8}"
#: Distinct characters of a live value, and digits of an opaque one, at least.
DISTINCT, DIGITS = 8, 3
#: Elements of an array that are summed one by one; longer arrays are summed by such blocks.
STEP = 256
SPAN = "array<struct<start:int,rank:int,end:int,hash:binary,looks:boolean>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def before(sizes: Column) -> Column:
    """For each element of an array the sum of those before it, in blocks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def summed(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STEP).cast("int")), lambda b: F.slice(a, b * STEP + 1, F.lit(STEP)))
        offsets = lambda bs: _let(F.transform(bs, total), lambda t: F.transform(t, lambda _, i: total(F.slice(t, F.lit(1), i))))
        inside = lambda block, at: F.transform(block, lambda _, i: at + total(F.slice(block, F.lit(1), i)))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, offsets(bs), inside)))

    return _let(sizes, summed)


def _cut(text: Column, pattern: str) -> Column:
    """The text as pairs of a gap and the match after it; the last gap has none."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, hit) of the leftmost matches that don't overlap, in code points."""

    def placed(parts: Column) -> Column:
        starts = before(F.transform(parts, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))))
        return F.zip_with(parts, starts, lambda p, at: F.struct((at + F.length(p["gap"])).alias("start"), (at + F.length(p["gap"]) + F.length(p["hit"])).alias("end"), p["hit"].alias("hit")))

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(text.rlike(pattern), F.filter(_let(_cut(text, pattern), placed), lambda m: m["hit"].isNotNull())).otherwise(none)


def _assigned(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN, 1)


def blanked(text: Column, pattern: str, counts: Callable[[Column], Column]) -> Column:
    """The text with as many blanks in place of the matches that count."""
    part = lambda p: F.concat(p["gap"], F.when(p["hit"].isNull(), "").when(counts(p["hit"]), F.repeat(F.lit(" "), F.length(p["hit"]))).otherwise(p["hit"]))
    return F.when(text.rlike(pattern), F.array_join(F.transform(_cut(text, pattern), part), "")).otherwise(text)


def looks_live(value: Column) -> Column:
    """Many distinct characters, a digit, and nothing that shows a placeholder."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def _spans(found: Column, rank: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    made = lambda m: F.struct(m["start"].alias("start"), rank(m["hit"]).cast("int").alias("rank"), m["end"].alias("end"), F.unhex(F.sha2(value(m["hit"]), 256)).alias("hash"), looks_live(value(m["hit"])).alias("looks"))
    return F.transform(found, made)


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, owner, repository, digest of the text, and all spans and candidates (SPAN) of each row; the digest is null where there are none."""
    long_enough = lambda hit: F.length(_assigned(hit)) >= ASSIGNED
    always = lambda hit: F.lit(True)
    whole = lambda hit: hit
    named = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository")]
    rows = docs.select(*named, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    assigned = F.filter(matches(text, ASSIGN), lambda m: long_enough(m["hit"]))
    rows = rows.withColumns({"assign": assigned, "access": matches(text, ACCESS), "hex": matches(text, HEX)})
    # Candidates are looked for where no base span is.
    rows = rows.withColumn("rest", blanked(text, ASSIGN, long_enough))
    rows = rows.withColumn("rest", blanked(F.col("rest"), ACCESS, always)).withColumn("rest", blanked(F.col("rest"), HEX, always))
    opaque = lambda hit: (F.length(F.regexp_replace(hit, "[^0-9]+", "")) >= DIGITS) & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    of_more = lambda hit: F.coalesce(*[F.when(hit.rlike(f"^(?:{p})"), len(KINDS) - len(MORE) + i) for i, p in enumerate(list(MORE.values())[:-1])], F.lit(len(KINDS) - 1))
    more = F.filter(matches(F.col("rest"), CANDIDATE), lambda m: (of_more(m["hit"]) < len(KINDS) - 1) | opaque(m["hit"]))
    rows = rows.withColumn("more", F.filter(_spans(more, of_more, whole), lambda s: s["looks"]))
    spans = F.concat(_spans(F.col("assign"), lambda _: F.lit(0), _assigned), _spans(F.col("access"), lambda _: F.lit(1), whole), _spans(F.col("hex"), lambda _: F.lit(2), whole), F.col("more"))
    rows = rows.withColumn("spans", F.array_sort(spans).cast(SPAN))
    digest = F.when(F.size("spans") > 0, F.unhex(F.sha2(text, 256)))
    return rows.select("doc_id", "owner", "repository", digest.alias("digest"), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """How many owners and repositories have each value: hash, owners, repositories."""
    each = found.where("digest is not null").select("owner", "repository", F.explode("spans.hash").alias("hash")).distinct()
    return each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id and spans: kind, start, end, verdict (live, example or placeholder), owners and repositories of each row's secrets."""
    found = stored(candidates(docs, owner, repository), "secrets")
    texts = found.where("digest is not null").groupBy("digest").agg(F.first("spans").alias("spans"))
    verdict = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(F.col("s.looks"), "live").otherwise("placeholder")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("s.rank") + 1)
    told = texts.select("digest", F.explode("spans").alias("s")).withColumn("hash", F.col("s.hash")).join(ownership(found), "hash").withColumn("verdict", verdict)
    told = told.where((F.col("s.rank") < len(KINDS) - len(MORE)) | (F.col("verdict") == "live"))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"), kind.alias("kind"), "verdict", "owners", "repositories")
    decided = told.groupBy("digest").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(decided.schema["spans"].dataType)
    with_spans = found.where("digest is not null").join(decided, "digest", "left").select("doc_id", F.coalesce(decided["spans"], none).alias("spans"))
    return with_spans.unionAll(found.where("digest is null").select("doc_id", none.alias("spans")))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The query's rows; beyond the contract the numbers of live values and of examples."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    many = lambda test: F.size(F.filter("spans", test)).cast("long")
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [many(of(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return secret_spans(docs).select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        many(lambda s: s["verdict"] == "live").alias("n_live"), many(lambda s: s["verdict"] == "example").alias("n_example"),
    )


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    value = f"regexp_extract(hit, {quoted(ASSIGN)}, 1)"
    looks = lambda v: f"(list_unique(string_split({v}, '')) >= {DISTINCT} and regexp_matches({v}, '[0-9]') and not regexp_matches({v}, {quoted(PLACEHOLDER)}))"
    total = lambda a, n: f"coalesce(list_sum(list_transform({a}[1:{n}], lambda x: length(x))), 0)"

    def found(name: str, source: str, pattern: str) -> str:
        return f"""{name} as (
  select rid, hits[i] as hit, ({total("gaps", "i")} + {total("hits", "i - 1")})::bigint as start from (
    select rid, gaps, hits, unnest(range(1, len(hits) + 1)) as i from (
      select rid, string_split_regex(text, {quoted(pattern)}) as gaps, regexp_extract_all(text, {quoted(pattern)}, 0) as hits from {source}
    )
  )
)"""

    def blank(name: str, source: str, pattern: str, counts: str) -> str:
        return f"""{name} as (
  select rid, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || case when i > len(hits) then '' when {counts.replace("hit", "hits[i]")} then repeat(' ', length(hits[i])) else hits[i] end), '') as text from (
    select rid, string_split_regex(text, {quoted(pattern)}) as gaps, regexp_extract_all(text, {quoted(pattern)}, 0) as hits from {source}
  )
)"""

    more = "".join(f" when regexp_matches(hit, {quoted(f'^(?:{p})')}) then {3 + i}" for i, p in enumerate(list(MORE.values())[:-1]))
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    joined = "string_agg({k}[rank + 1] || ':' || start || ':' || stop, ',' order by start, rank, stop)".replace("{k}", kinds)
    return f"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, coalesce(doc_id::varchar, '') as repository from documents
), {found("a", "docs", ASSIGN)}, {found("k", "docs", ACCESS)}, {found("h", "docs", HEX)},
{blank("r1", "docs", ASSIGN, f"length({value}) >= {ASSIGNED}")},
{blank("r2", "r1", ACCESS, "true")}, {blank("r3", "r2", HEX, "true")}, {found("m", "r3", CANDIDATE)},
ranked as (
  select *, case{more} else {len(KINDS) - 1} end as rank from m
), spans as (
  select rid, 0 as rank, start, start + length(hit) as stop, {value} as value from a where length({value}) >= {ASSIGNED}
  union all select rid, 1, start, start + length(hit), hit from k
  union all select rid, 2, start, start + length(hit), hit from h
  union all select rid, rank, start, start + length(hit), hit from ranked
  where {looks("hit")} and (rank < {len(KINDS) - 1} or (length(regexp_replace(hit, '[^0-9]+', '', 'g')) >= {DIGITS} and regexp_matches(hit, '[a-z]') and regexp_matches(hit, '[A-Z]')))
), owned as (
  select value, count(distinct owner) as owners from spans join docs using (rid) group by value
), told as (
  select rid, rank, start, stop, case when owners >= {EXAMPLE_OWNERS} then 'example' when {looks("value")} then 'live' else 'placeholder' end as verdict
  from spans join owned using (value)
), kept as (
  select * from told where rank < 3 or verdict = 'live'
), digests as (
  select rid, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    coalesce({joined} filter (rank < 3), '') as base, {joined} as spans,
    count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example
  from kept group by rid
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from docs left join digests using (rid)
"""


SQL = _sql()
