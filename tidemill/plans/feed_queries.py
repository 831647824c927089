"""The feed-refinement operators on the driver's tables, with the SQL that says the same.

The rule sets are examples over words that occur in the data: rules are parameters of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scalars as S
from tidemill.functions import text as X
from tidemill.operators import checks, dedupe, learning, matching, reserve, rules, telemetry
from tidemill.session import table
from tidemill.sources import feeds
from tidemill.streaming import state

AS_OF_US = 1_779_148_800_000_000  # 2026-05-19 00:00 UTC, the clock of all ages below
STRONG = [("annotator", 20), ("rater", 18), ("data entry", 16), ("transcription", 16), ("校正", 14), ("文字起こし", 14)]
MEDIUM = [("review", 6), ("label", 6), ("guideline", 4), ("remote", 5), ("在宅", 8), ("確認", 3)]
SOFT = [("phone", 8), ("calls", 10), ("meeting", 12), ("shift", 9)]
HARD = ["on-site", "出社"]
NEGATED = ["no calls or meetings", "no phone"]
RULES = rules.ScoreRules(STRONG, MEDIUM, SOFT, HARD, NEGATED)
FAMILIES = [("transcri|文字起こし", "audio"), ("image|画像|photo", "image"), ("translat|翻訳", "language"), ("data entry|データ入力", "entry"), ("rater|評価", "rating")]
MARKERS = ["## FAQ", "## How to apply", "## Pay and hours"]
AUGMENT = [("rater", "quality rating"), ("transcription", "audio text"), ("翻訳", "translation")]
HOSTS = [("kelmora-0.example", "hot"), ("boards.kelmora-0.example", "hot board"), ("example", "other")]

_SP = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"
Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sq(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SP}', ' ', 'g'))"


def _un(text: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"


def _has(text: str, p: str) -> str:
    return f"contains({text}, '{p}')"


def _sum(text: str, weights) -> str:
    return "(" + " + ".join(f"CASE WHEN {_has(text, p)} THEN {w} ELSE 0 END" for p, w in weights) + ")"


def _clamp(x: str) -> str:
    return f"greatest(0, least(100, round_even(({x})::DOUBLE, 0)::INT))"


def _reason(cases) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in cases) + " END"


# --- text ---------------------------------------------------------------------------------------------------------


@_q(f"SELECT doc_id, {_sq(_un(_strip('text')))} AS cleaned FROM documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@_q(f"SELECT DISTINCT id, {_sq(_strip(_un('content')))} AS cleaned FROM greenhouse_postings")
def escaped_markup_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "greenhouse_postings").select("id", X.clean(F.col("content"), escaped_markup=True).alias("cleaned")).distinct()


@_q(
    "SELECT posting_no, "
    + _sq(_un(_strip("regexp_replace(descriptionHtml, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g')")))
    + " AS page FROM ashby_postings"
)
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ashby_postings").select("posting_no", X.page_text(F.col("descriptionHtml")).alias("page"))


@_q()
def html_unescape(spark: SparkSession, d: str) -> DataFrame:
    """All entities, by an Arrow function (SQL has none for it)."""
    return table(spark, d, "documents").where(F.contains("text", F.lit("&"))).select("doc_id", X.unescape(F.col("text")).alias("plain"))


@_q(
    "SELECT doc_id, CASE WHEN pos IS NULL THEN text ELSE rtrim(text[1:pos - 1], ' ') END AS head FROM (SELECT doc_id, text, least("
    + ", ".join(f"CASE WHEN instr(text, '{m}') > 1 THEN instr(text, '{m}') END" for m in MARKERS)
    + ") AS pos FROM documents)"
)
def cut_at_marker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.cut_at(F.col("text"), MARKERS).alias("head"))


@_q(
    f"SELECT doc_id, CASE WHEN coalesce(h, '') = '' THEN 'untitled' ELSE h[1:60] END AS heading FROM (SELECT doc_id, {_sq(chr(39).join(['regexp_extract(text, ', '(?m)^#{1,3} +([^' + chr(92) + 'n' + chr(92) + 'r]+)', ', 1)']))} AS h FROM documents)"
)
def first_heading(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.first_heading(F.col("text"), 60, "untitled").alias("heading"))


@_q()
def identity_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """``company|title`` after NFKC (no SQL twin); compared with the delivered fingerprint in the tests."""
    df = table(spark, d, "candidates").select("cand_no", "id", X.identity(F.coalesce("company", F.lit(""))).alias("c"), X.identity(F.coalesce("title", F.lit(""))).alias("t"))
    return df.select("cand_no", X.fingerprint(F.col("c"), F.col("t"), F.col("id")).alias("key"))


@_q("SELECT cand_no, trim(regexp_replace(lower(title), '[^0-9a-zぁ-んァ-ヶー一-龯]+', ' ', 'g')) AS key FROM candidates")
def word_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", X.word_key(F.col("title")).alias("key"))


@_q(
    "SELECT cand_no, "
    + _sq("regexp_replace(regexp_replace(title, '(?i)\\s*[(（][^()（）]*(?:contract|weekend|remote)[^()（）]*[)）]', '', 'g'), '(?i)\\s+[-–/]\\s+(?:contract|weekend|remote)\\s*$', '', 'g')")
    + " AS role FROM candidates"
)
def canonical_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", X.without_suffixes(F.col("title"), ["contract", "weekend", "remote"]).alias("role"))


@_q("SELECT cand_no, CASE WHEN length(snippet) > 120 THEN concat(rtrim(snippet[1:117], ' '), '...') ELSE snippet END AS snippet FROM candidates")
def truncate_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", X.excerpt(F.col("snippet"), 120).alias("snippet"))


@_q(
    """SELECT listing_id, concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(location, ''), coalesce(description, ''),
  coalesce(array_to_string(flatten(list_transform(job_highlights, lambda h: list_concat([h.title], h.items))), ' '), ''), coalesce(array_to_string(extensions, ' '), '')) AS document FROM listings"""
)
def listing_document(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "listings")
    return df.select("listing_id", X.joined(F.col("title"), F.col("company"), F.col("location"), F.col("description"), X.highlights("job_highlights"), F.array_join("extensions", " ")).alias("document"))


@_q("SELECT cand_no, concat_ws(' ', title, " + ", ".join(f"CASE WHEN {_has('lower(title)', t)} THEN '{w}' END" for t, w in AUGMENT) + ") AS text FROM candidates")
def vocabulary_augment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", X.augmented(F.col("title"), AUGMENT).alias("text"))


# --- URLs, dates, numbers -----------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_SAFE = "CASE WHEN regexp_matches({0}, '^https://[^/?#@\\s]+/[^?#\\s]') AND length({0}) <= 2048 THEN regexp_replace({0}, '#.*$', '') END"
_LINKS = "(SELECT listing_id, unnest(apply_options).link AS link FROM listings)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings").select("listing_id", F.explode("apply_options.link").alias("link"))


@_q(f"SELECT listing_id, link, url, 'apply-' || sha256(url)[1:24] AS target FROM (SELECT listing_id, link, {_SAFE.format('link')} AS url FROM {_LINKS})")
def stable_target(spark: SparkSession, d: str) -> DataFrame:
    df = _links(spark, d).withColumn("url", S.safe_https(F.col("link")))
    return df.withColumn("target", S.stable_id(F.col("url")))


@_q(f"SELECT listing_id, link, host, {_reason([(f'(host = {chr(39)}{s}{chr(39)} OR ends_with(host, {chr(39)}.{s}{chr(39)}))', r) for s, r in HOSTS])} AS label FROM (SELECT listing_id, link, {_HOST.format('link')} AS host FROM {_LINKS})")
def host_rule(spark: SparkSession, d: str) -> DataFrame:
    df = _links(spark, d).withColumn("host", S.host(F.col("link")))
    return df.withColumn("label", S.first_host_rule(F.col("host"), HOSTS))


@_q("SELECT cand_no, CASE WHEN regexp_matches(seed.url, '^https://([^/?#]*\\.)?joblane\\.example/viewjob/?\\?(.*&)?jk=[A-Za-z0-9_-]{6,128}(&|#|$)') THEN regexp_extract(seed.url, '[?&]jk=([^&#]*)', 1) END AS jk FROM candidates")
def viewed_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", S.viewed_id(F.col("seed.url"), "joblane.example").alias("jk"))


@_q(
    """SELECT listing_id, CASE WHEN p IN ('新着', 'たった今', 'just posted', 'today') THEN 0
  WHEN regexp_matches(p, '\\d+\\s*(分|minutes?)') THEN regexp_extract(p, '(\\d+)\\s*(分|minutes?)', 1)::INT
  WHEN regexp_matches(p, '\\d+\\s*(時間|hours?|hrs?)') THEN regexp_extract(p, '(\\d+)\\s*(時間|hours?|hrs?)', 1)::INT * 60
  WHEN regexp_matches(p, '\\d+\\s*(日|days?)') THEN CASE WHEN regexp_matches(p, '[+]|以上') THEN greatest(31, d) ELSE d END * 1440
  WHEN regexp_matches(p, '\\d+\\s*(週|weeks?)') THEN regexp_extract(p, '(\\d+)\\s*(週|weeks?)', 1)::INT * 10080
  WHEN regexp_matches(p, '\\d+\\s*(か月|ヶ月|ヵ月|months?)') THEN regexp_extract(p, '(\\d+)\\s*(か月|ヶ月|ヵ月|months?)', 1)::INT * 43200
  WHEN regexp_matches(p, '\\d+[+]?\\s*days?\\s*ago') THEN CASE WHEN regexp_matches(p, '[+]') THEN greatest(31, x) ELSE x END * 1440 END AS minutes
FROM (SELECT *, try_cast(regexp_extract(p, '(\\d+)\\s*(日|days?)', 1) AS INT) AS d, try_cast(regexp_extract(p, '(\\d+)[+]?\\s*days?\\s*ago', 1) AS INT) AS x
  FROM (SELECT listing_id, trim(lower(translate(detected_extensions.posted_at, '０１２３４５６７８９＋', '0123456789+'))) AS p FROM listings))"""
)
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings").select("listing_id", S.relative_minutes(F.col("detected_extensions.posted_at")).alias("minutes"))


_AGE = f"(({AS_OF_US} - epoch_us({{0}})) / 86400000000.0::DOUBLE)"
_FRESH = "CASE WHEN {0} IS NULL THEN 40 WHEN {0} <= 1 THEN 98 WHEN {0} <= 3 THEN 92 WHEN {0} <= 7 THEN 84 WHEN {0} <= 14 THEN 70 WHEN {0} <= 30 THEN 52 WHEN {0} <= 60 THEN 34 ELSE 18 END"


def _age(at: str):
    return (F.lit(AS_OF_US) - F.unix_micros(at)) / F.lit(86400000000.0)


@_q(f"SELECT cand_no, {_FRESH.format('age')} AS fresh FROM (SELECT cand_no, {_AGE.format('first_seen')} AS age FROM candidates)")
def freshness_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", S.freshness(_age("first_seen")).alias("fresh"))


_DAYS = "(SELECT o_orderdate::DATE AS day, count(*)::INT AS used FROM orders GROUP BY ALL)"
_LEFT = "greatest(1, datediff('day', day, (date_trunc('month', day) + INTERVAL 1 MONTH)::DATE))"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("int").alias("used"))


@_q(f"SELECT day, CASE WHEN 245 - used <= 0 THEN 0 ELSE greatest(1, floor((245 - used) / {_LEFT})::INT) END AS allowed FROM {_DAYS}")
def budget_pacing(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d).select("day", S.paced(F.col("used"), 245, F.col("day")).alias("allowed"))


@_q(f"SELECT day, CASE WHEN used < 3 THEN 7 WHEN used < 6 THEN 6 WHEN used < 12 THEN 4 ELSE 2 END AS requests FROM {_DAYS}")
def request_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d).select("day", S.ladder(F.col("used"), [(3, 7), (6, 6), (12, 4)], 2).alias("requests"))


@_q(f"SELECT day, greatest(0, least(50 - used - 2, CASE WHEN used % 2 = 0 THEN 20 END)) AS room FROM {_DAYS}")
def headroom(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d).select("day", S.headroom(F.col("used"), 50, 2, F.when(F.col("used") % 2 == 0, 20)).alias("room"))


# --- scores, gates, classes ---------------------------------------------------------------------------------------


def _scrub_sql(text: str) -> str:
    for p in NEGATED:
        text = f"replace({text}, '{p}', ' ')"
    return text


_HITS = _sum("t", [(p, 1) for p, _ in STRONG])
_SCORED = f"""
(SELECT *, CASE WHEN hard THEN least(o, 54) ELSE o END AS overall FROM
 (SELECT *, {_clamp('strength * 0.6::DOUBLE + fresh * 0.3::DOUBLE + 10.0::DOUBLE - risk * 0.42::DOUBLE')} AS o FROM
  (SELECT *, {_clamp('12 + ' + _sum('t', STRONG) + ' + ' + _sum('t', MEDIUM) + f' + CASE WHEN {_HITS} >= 2 THEN 12 WHEN {_HITS} = 0 THEN -18 ELSE 0 END')} AS strength,
      {_clamp(_sum('z', SOFT) + ' + CASE WHEN hard THEN 70 ELSE 0 END')} AS risk FROM
   (SELECT *, {' OR '.join(_has('z', p) for p in HARD)} AS hard FROM
    (SELECT *, {_scrub_sql('t')} AS z FROM
     (SELECT cand_no, board, company, title, location, lower(concat_ws(' ', coalesce(title, ''), coalesce(location, ''), coalesce(snippet, ''))) AS t, {_FRESH.format(_AGE.format('first_seen'))} AS fresh, first_seen FROM candidates)))))) s"""
_TIER = "CASE WHEN overall >= 60 AND risk <= 20 AND NOT hard THEN 'high' WHEN overall >= 35 AND risk <= 45 AND NOT hard THEN 'review' ELSE 'hidden' END"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(X.joined(F.col("title"), F.col("location"), F.col("snippet")))
    return table(spark, d, "candidates").select("cand_no", "board", "company", "title", "location", "snippet", "first_seen", text.alias("t"), S.freshness(_age("first_seen")).alias("fresh"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return rules.scored(_candidates(spark, d), "t", "fresh", RULES)


@_q(f"SELECT cand_no, strength, risk, overall FROM {_SCORED}")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("cand_no", "strength", "risk", "overall")


@_q(f"SELECT cand_no, {_TIER} AS tier FROM {_SCORED}")
def tier_classify(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("cand_no", "tier")


_ALL_HITS = "[" + ", ".join(f"CASE WHEN {_has('t', p)} THEN '{p}' END" for p, _ in STRONG + MEDIUM) + "]"


@_q(f"SELECT cand_no, array_to_string(list_filter({_ALL_HITS}, lambda x: x IS NOT NULL)[1:6], ',') AS reasons FROM {_SCORED}")
def reason_arrays(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("cand_no", "reasons")


@_q(f"SELECT cand_no, {_scrub_sql('t')} AS scrubbed FROM {_SCORED}")
def negation_scrub(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("cand_no", rules.scrub(F.col("t"), NEGATED).alias("scrubbed"))


_GATE = [("company IS NULL OR company = ''", "no-company"), ("contains(z, '出社') OR contains(z, 'on-site')", "presence"), ("contains(z, 'calls') OR contains(z, 'meeting')", "coordination"), ("NOT regexp_matches(t, 'remote|在宅|anywhere|リモート')", "not-remote")]


def _gated(spark: SparkSession, d: str) -> DataFrame:
    df = _candidates(spark, d).withColumn("z", rules.scrub(F.col("t"), NEGATED))
    z = F.col("z")
    return df.withColumn("reason", rules.first_reason([
        (F.col("company").isNull() | (F.col("company") == ""), "no-company"), (rules.contains_any(z, ["出社", "on-site"]), "presence"),
        (rules.contains_any(z, ["calls", "meeting"]), "coordination"), (~F.col("t").rlike("remote|在宅|anywhere|リモート"), "not-remote"),
    ]))


_GATED = f"(SELECT *, {_reason(_GATE)} AS reason FROM {_SCORED})"


@_q(f"SELECT cand_no, reason FROM {_GATED}")
def gate_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("cand_no", "reason")


@_q(f"SELECT reason, count(*) AS n FROM {_GATED} WHERE reason IS NOT NULL GROUP BY reason")
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@_q(
    f"""WITH c AS (SELECT board, reason, count(*) AS n FROM {_GATED} GROUP BY ALL),
r AS (SELECT board, reason, n, row_number() OVER (PARTITION BY board ORDER BY n DESC, reason) AS rn FROM c WHERE reason IS NOT NULL),
t AS (SELECT board, string_agg(reason || '=' || n, ',' ORDER BY rn) AS reasons FROM r WHERE rn <= 2 GROUP BY board)
SELECT c.board, sum(n)::BIGINT AS evaluated, sum(CASE WHEN reason IS NULL THEN n ELSE 0 END)::BIGINT AS accepted, sum(CASE WHEN reason IS NULL THEN 0 ELSE n END)::BIGINT AS rejected, any_value(t.reasons) AS reasons
FROM c LEFT JOIN t ON c.board IS NOT DISTINCT FROM t.board GROUP BY c.board"""
)
def funnel_by_source(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.funnel(_gated(spark, d), "board", "reason", 2).select("board", "evaluated", "accepted", "rejected", "reasons")


@_q(
    """SELECT via, seen, with_links, secure, CASE WHEN seen > 0 THEN round_even(with_links * 100.0::DOUBLE / seen, 1) ELSE 0 END AS link_rate FROM (
 SELECT via, count(*) AS seen, count(*) FILTER (len(apply_options) > 0) AS with_links, count(*) FILTER (len(list_filter(apply_options, lambda x: starts_with(x.link, 'https://'))) > 0) AS secure FROM listings GROUP BY via)"""
)
def yield_rates(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "listings").groupBy("via").agg(
        F.count("*").alias("seen"), F.count_if(F.size("apply_options") > 0).alias("with_links"),
        F.count_if(F.exists("apply_options", lambda x: F.startswith(x["link"], F.lit("https://")))).alias("secure"),
    )
    return df.withColumn("link_rate", telemetry.share("with_links", "seen"))


@_q("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.leading(table(spark, d, "documents"), "source", 10)


@_q("SELECT count(*) FILTER (full_listing_presence_screened) AS screened, count(*) FILTER (remote_search_only) AS remote_only, count(*) FILTER (score >= 80) AS strong, count(DISTINCT fingerprint) AS opportunities FROM candidates")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").agg(
        F.count_if("full_listing_presence_screened").alias("screened"), F.count_if("remote_search_only").alias("remote_only"),
        F.count_if(F.col("score") >= 80).alias("strong"), F.countDistinct("fingerprint").alias("opportunities"),
    )


@_q(f"SELECT cand_no, coalesce({_reason([(f'regexp_matches(lower(title), {chr(39)}{p}{chr(39)})', n) for p, n in FAMILIES])}, 'other') AS family FROM candidates")
def classify_family(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", rules.first_match(F.lower("title"), FAMILIES, "other").alias("family"))


@_q("SELECT cand_no, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(title, '')), '{p}') THEN '{n}' END" for p, n in FAMILIES) + "], lambda x: x IS NOT NULL)[1:3], ',') AS tags FROM candidates")
def tag_labels(spark: SparkSession, d: str) -> DataFrame:
    title = F.lower(F.coalesce("title", F.lit("")))
    return table(spark, d, "candidates").select("cand_no", F.array_join(X.distinct_labels([(title.rlike(p), n) for p, n in FAMILIES], 3), ",").alias("tags"))


@_q("SELECT cand_no, CASE WHEN regexp_matches(title, '[ぁ-んァ-ヶ一-龯]') THEN 60 ELSE 0 END + CASE WHEN location IN ('東京都', '大阪府', '在宅') THEN 30 ELSE 5 END + length(regexp_replace(title, '[^ぁ-んァ-ヶ一-龯]', '', 'g')) AS priority FROM candidates")
def locale_priority(spark: SparkSession, d: str) -> DataFrame:
    kana = "[ぁ-んァ-ヶ一-龯]"
    return table(spark, d, "candidates").select("cand_no", (
        F.when(F.col("title").rlike(kana), 60).otherwise(0) + F.when(F.col("location").isin("東京都", "大阪府", "在宅"), 30).otherwise(5) + F.length(F.regexp_replace("title", "[^ぁ-んァ-ヶ一-龯]", ""))
    ).alias("priority"))


# --- duplicates, snapshots, joins ---------------------------------------------------------------------------------

_BEST = "coalesce(score, -1) DESC, cand_no"


def _order():
    return [F.desc(F.coalesce("score", F.lit(-1))), F.col("cand_no")]


@_q(f"SELECT fingerprint, cand_no FROM candidates QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY {_BEST}) = 1")
def best_of_key(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.best_of(table(spark, d, "candidates").select("fingerprint", "cand_no", "score"), ["fingerprint"], _order()).select("fingerprint", "cand_no")


def _groups_sql(count: str) -> str:
    return f"""WITH b AS (SELECT fingerprint, cand_no FROM candidates QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY {_BEST}) = 1),
n AS (SELECT fingerprint, {count}::BIGINT AS duplicate_count FROM candidates GROUP BY fingerprint),
p AS (SELECT fingerprint, location, row_number() OVER (PARTITION BY fingerprint ORDER BY location) AS rn FROM (SELECT DISTINCT fingerprint, location FROM candidates WHERE location IS NOT NULL)),
a AS (SELECT fingerprint, string_agg(location, '; ' ORDER BY location) AS alternates FROM p WHERE rn <= 8 GROUP BY fingerprint)
SELECT fingerprint, cand_no, duplicate_count, alternates FROM b JOIN n USING (fingerprint) LEFT JOIN a USING (fingerprint)"""


@_q(_groups_sql("count(*)"))
def fingerprint_dedupe(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "candidates").select("fingerprint", "cand_no", "score", "location")
    return dedupe.duplicate_groups(df, "fingerprint", _order(), "location", 8).select("fingerprint", "cand_no", "duplicate_count", "alternates")


@_q(_groups_sql("sum(greatest(1, coalesce(presence_gate_version, 1)))"))
def semantic_dedupe(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "candidates").select("fingerprint", "cand_no", "score", "location", "presence_gate_version")
    return dedupe.duplicate_groups(df, "fingerprint", _order(), "location", 8, "presence_gate_version").select("fingerprint", "cand_no", "duplicate_count", "alternates")


def _snap(spark: SparkSession, d: str, n: int) -> DataFrame:
    return table(spark, d, "feed_snapshots").where(F.col("snapshot_no") == n).dropDuplicates()


_KEY = "concat_ws('|', company, title)"


@_q(
    f"""WITH p AS (SELECT DISTINCT *, {_KEY} AS key FROM feed_snapshots WHERE snapshot_no = 6), c AS (SELECT id, {_KEY} AS key FROM feed_snapshots WHERE snapshot_no = 7)
SELECT id, key, least(score, greatest(28, 66 - 3 * coalesce(verification_age_days, 0))) AS carried_score FROM p
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = p.id) AND NOT EXISTS (SELECT 1 FROM c WHERE c.key = p.key)"""
)
def carryover_antijoin(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", "company", "title")
    old, new = _snap(spark, d, 6).withColumn("key", key), _snap(spark, d, 7).withColumn("key", key)
    kept = reserve.carried(old, new, ["id", "key"])
    return kept.select("id", "key", reserve.decayed(F.col("score"), F.coalesce("verification_age_days", F.lit(0)), 66, 3, 28).alias("carried_score"))


@_q("SELECT count(*) AS n_new FROM (SELECT DISTINCT id FROM feed_snapshots WHERE snapshot_no = 7 AND id IS NOT NULL) WHERE id NOT IN (SELECT id FROM feed_snapshots WHERE snapshot_no = 6 AND id IS NOT NULL)")
def new_rows(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda n: table(spark, d, "feed_snapshots").where(F.col("snapshot_no") == n).where("id IS NOT NULL").select("id").distinct()
    return ids(7).join(ids(6), "id", "left_anti").agg(F.count("*").alias("n_new"))


@_q("SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.s ELSE n.s END AS score FROM (SELECT id, max(score) AS s FROM feed_snapshots WHERE snapshot_no = 7 AND id IS NOT NULL GROUP BY id) n FULL JOIN (SELECT id, max(score) AS s FROM feed_snapshots WHERE snapshot_no = 6 AND id IS NOT NULL GROUP BY id) o ON n.id = o.id")
def stock_upsert(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n: table(spark, d, "feed_snapshots").where((F.col("snapshot_no") == n) & F.col("id").isNotNull()).groupBy("id").agg(F.max("score").alias("score"))
    return reserve.upsert(side(6), side(7), "id")


_PREV = "(SELECT user_id, epoch_us(min(ts)) AS f, count(*) AS s FROM events WHERE event_type = 'view' GROUP BY user_id)"
_FRESH_U = "(SELECT user_id, epoch_us(min(ts)) AS f FROM events WHERE event_type = 'click' GROUP BY user_id)"


@_q(f"SELECT c.user_id, coalesce(p.f, c.f) AS first_seen, coalesce(p.s, 0) + 1 AS seen_count, p.s IS NULL AS is_new FROM {_FRESH_U} c LEFT JOIN {_PREV} p USING (user_id)")
def seen_count_lookup(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    prev = ev.where("event_type = 'view'").groupBy("user_id").agg(F.min("us").alias("first_seen"), F.count("*").alias("seen_count"))
    fresh = ev.where("event_type = 'click'").groupBy("user_id").agg(F.min("us").alias("first_seen")).withColumn("seen_count", F.lit(0))
    return reserve.seen_again(fresh, prev, "user_id").select("user_id", "first_seen", "seen_count", "is_new")


@_q("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)")
def user_actions(spark: SparkSession, d: str) -> DataFrame:
    c, o, e = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "events").where("event_type = 'error'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").join(e, c.c_custkey == e.user_id, "left_anti").select("c_custkey", "c_mktsegment")


@_q("SELECT DISTINCT a.id, 'declined' AS action FROM candidates a JOIN (SELECT DISTINCT fingerprint FROM candidates WHERE tier = 'hidden') h USING (fingerprint)")
def continuity(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "candidates").select("id", "fingerprint", "tier")
    return df.join(df.where("tier = 'hidden'").select("fingerprint").distinct(), "fingerprint", "left_semi").select("id", F.lit("declined").alias("action")).distinct()


_SEED = "(SELECT seed.jk AS jk, bool_or(seed.indeed_index_link_kind = 'viewjob-jk') AS direct, max(seed.title) AS title FROM candidates WHERE seed.jk IS NOT NULL AND (epoch_us(first_seen) < 1764547200000000) = {0} GROUP BY seed.jk)"


@_q(
    f"""SELECT coalesce(o.jk, n.jk) AS jk, CASE WHEN k THEN o.direct ELSE n.direct END AS direct, CASE WHEN k THEN o.title ELSE n.title END AS title FROM
(SELECT o, n, n.jk IS NULL OR (coalesce(o.direct, false) AND NOT coalesce(n.direct, false)) AS k FROM {_SEED.format('true')} o FULL JOIN {_SEED.format('false')} n ON o.jk = n.jk)"""
)
def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    """The older seeds and the newer ones (the whole table in two parts, by date), merged by evidence."""
    df = table(spark, d, "candidates").where("seed.jk IS NOT NULL")
    side = lambda p: df.where((F.unix_micros("first_seen") < 1764547200000000) == p).groupBy(F.col("seed.jk").alias("jk")).agg(F.bool_or(F.col("seed.indeed_index_link_kind") == "viewjob-jk").alias("direct"), F.max("seed.title").alias("title"))
    return reserve.merged_seeds(side(True), side(False), "jk", "direct", ["title"])


@_q()
def similarity_topmatch(spark: SparkSession, d: str) -> DataFrame:
    """Seeds matched one-to-one with candidates of the same company by title similarity (no SQL twin)."""
    df = table(spark, d, "candidates")
    seeds = df.where("seed.jk IS NOT NULL").groupBy(F.col("seed.jk").alias("jk")).agg(F.min("company").alias("company"), F.min("seed.title").alias("title"))
    rows = dedupe.best_of(df.select("cand_no", "company", "title", "fingerprint"), ["fingerprint"], [F.col("cand_no")])
    return matching.best_matches(seeds, rows, "jk", "cand_no", "title")


@_q("SELECT coalesce(o.id, n.id) AS id, o.s AS before, n.s AS after FROM (SELECT id, max(tier) AS s FROM feed_snapshots WHERE snapshot_no = 1 AND id IS NOT NULL GROUP BY id) o JOIN (SELECT id, max(tier) AS s FROM feed_snapshots WHERE snapshot_no = 8 AND id IS NOT NULL GROUP BY id) n ON o.id = n.id WHERE o.s IS DISTINCT FROM n.s")
def promotion_revert(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n, c: table(spark, d, "feed_snapshots").where((F.col("snapshot_no") == n) & F.col("id").isNotNull()).groupBy("id").agg(F.max("tier").alias(c))
    return side(1, "before").join(side(8, "after"), "id").where(~F.col("before").eqNullSafe(F.col("after")))


# the queries above are one step of their tables, as their SQL says; these take each delivery against the one before it
_STEPS = """WITH n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM feed_snapshots WHERE snapshot_no IS NOT NULL)),
c AS (SELECT DISTINCT f.* FROM feed_snapshots f JOIN n USING (snapshot_no) WHERE n.before IS NOT NULL),
p AS (SELECT DISTINCT f.* REPLACE (n.snapshot_no AS snapshot_no) FROM feed_snapshots f JOIN n ON f.snapshot_no = n.before)
"""


def _steps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return reserve.with_previous(table(spark, d, "feed_snapshots").dropDuplicates(), "snapshot_no")


@_q(
    f"""{_STEPS} SELECT snapshot_no, id, {_KEY} AS key, least(score, greatest(28, 66 - 3 * coalesce(verification_age_days, 0))) AS carried_score FROM p
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.snapshot_no = p.snapshot_no AND c.id = p.id)
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.snapshot_no = p.snapshot_no AND concat_ws('|', c.company, c.title) = concat_ws('|', p.company, p.title))"""
)
def carryover_steps(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", "company", "title")
    _, new, old = _steps(spark, d)
    kept = reserve.carried(old.withColumn("key", key), new.withColumn("key", key), ["id", "key"], ["snapshot_no"])
    return kept.select("snapshot_no", "id", "key", reserve.decayed(F.col("score"), F.coalesce("verification_age_days", F.lit(0)), 66, 3, 28).alias("carried_score"))


@_q(f"{_STEPS} SELECT snapshot_no, (SELECT count(DISTINCT c.id) FROM c WHERE c.snapshot_no = n.snapshot_no AND NOT EXISTS (SELECT 1 FROM p WHERE p.snapshot_no = c.snapshot_no AND p.id = c.id)) AS n_new FROM n WHERE before IS NOT NULL")
def new_rows_steps(spark: SparkSession, d: str) -> DataFrame:
    steps, new, old = _steps(spark, d)
    ids = lambda df: df.where("id IS NOT NULL").select("snapshot_no", "id").distinct()
    counts = ids(new).join(ids(old), ["snapshot_no", "id"], "left_anti").groupBy("snapshot_no").agg(F.count("*").alias("n_new"))
    return steps.join(counts, "snapshot_no", "left").select("snapshot_no", F.coalesce("n_new", F.lit(0)).alias("n_new"))


def _sides_sql(column: str) -> str:
    side = lambda t: f"(SELECT snapshot_no, id, max({column}) AS s FROM {t} WHERE id IS NOT NULL GROUP BY ALL)"
    return f"{_STEPS}, a AS {side('c')}, b AS {side('p')}"


@_q(f"{_sides_sql('score')} SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN b.s ELSE a.s END AS score FROM a FULL JOIN b ON a.snapshot_no = b.snapshot_no AND a.id = b.id")
def stock_upsert_steps(spark: SparkSession, d: str) -> DataFrame:
    _, new, old = _steps(spark, d)
    side = lambda df: df.where("id IS NOT NULL").groupBy("snapshot_no", "id").agg(F.max("score").alias("score"))
    return reserve.upsert(side(old), side(new), "snapshot_no", "id")


@_q(f"{_sides_sql('tier')} SELECT a.snapshot_no, a.id, b.s AS before, a.s AS after FROM a JOIN b ON a.snapshot_no = b.snapshot_no AND a.id = b.id WHERE a.s IS DISTINCT FROM b.s")
def promotion_revert_steps(spark: SparkSession, d: str) -> DataFrame:
    _, new, old = _steps(spark, d)
    side = lambda df, c: df.where("id IS NOT NULL").groupBy("snapshot_no", "id").agg(F.max("tier").alias(c))
    return side(old, "before").join(side(new, "after"), ["snapshot_no", "id"]).where(~F.col("before").eqNullSafe(F.col("after")))


# --- learning and order -------------------------------------------------------------------------------------------

_RUNS = "(SELECT event_type, day, count(*)::DOUBLE AS v FROM (SELECT event_type, ts::DATE AS day FROM events) GROUP BY ALL)"


@_q(f"SELECT event_type, list_reduce(list_prepend(0.0::DOUBLE, list(v ORDER BY day)), lambda a, x: round_even(a * 0.82::DOUBLE, 4) + x) AS weight FROM {_RUNS} GROUP BY event_type")
def decay_fold(spark: SparkSession, d: str) -> DataFrame:
    runs = learning.ordered_values(table(spark, d, "events").withColumn("day", F.to_date("ts")), "event_type", "day", F.count("*"))
    return runs.select("event_type", learning.decayed_fold(F.col("runs"), 0.82).alias("weight"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("seen"), F.count_if(F.col("lang") == "en").alias("final"), F.count_if(F.col("n_chars") > 800).alias("accepted"), F.count_if(F.col("n_chars").isNull()).alias("rejected"))
    return df.withColumn("score", learning.precision_score(F.lit(50.0), F.col("seen"), F.col("final"), F.col("accepted"), F.col("rejected")))


_SRC = "(SELECT source, round_even(50.0::DOUBLE + (0.35::DOUBLE + 0.65::DOUBLE * least(1.0::DOUBLE, seen / 20.0::DOUBLE)) * (f / seen * 500.0::DOUBLE + a / seen * 180.0::DOUBLE - r / seen * 120.0::DOUBLE), 4) AS score, seen FROM (SELECT source, count(*)::DOUBLE AS seen, (count(*) FILTER (lang = 'en'))::DOUBLE AS f, (count(*) FILTER (n_chars > 800))::DOUBLE AS a, (count(*) FILTER (n_chars IS NULL))::DOUBLE AS r FROM documents GROUP BY source))"


@_q(f"SELECT source, score FROM {_SRC}")
def precision_score(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("source", "score")


@_q(
    f"""SELECT source, row_number() OVER (ORDER BY CASE WHEN rk < p THEN (rk // 2) * 3 + rk % 2 ELSE (rk - p) * 3 + 2 END)::INT AS slot FROM
(SELECT *, ceil(n * 2 / 3)::BIGINT AS p FROM (SELECT source, row_number() OVER (ORDER BY score DESC, source) - 1 AS rk, count(*) OVER () AS n FROM {_SRC}))"""
)
def exploit_explore(spark: SparkSession, d: str) -> DataFrame:
    return learning.two_to_one(_sources(spark, d), "score", "source").select("source", "slot")


@_q(f"SELECT source, (rk - 7 + n) % n AS pos FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS rk, count(*) OVER () AS n FROM {_SRC})")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    df = _sources(spark, d).select("source", (F.row_number().over(W.orderBy("source")) - 1).alias("rk"), F.count("*").over(W.partitionBy()).alias("n"))
    return df.select("source", learning.rotated(F.col("rk"), 7, F.col("n")).cast("bigint").alias("pos"))


@_q("SELECT source, max(n) AS n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT profile, count(*) FROM raw_cards GROUP BY profile) GROUP BY source")
def max_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    b = table(spark, d, "raw_cards").groupBy(F.col("profile").alias("source")).agg(F.count("*").alias("n"))
    return a.unionByName(b).groupBy("source").agg(F.max("n").alias("n"))


@_q(f"SELECT split_part(source, '-', 1) AS family, sum(seen)::BIGINT AS seen FROM {_SRC} GROUP BY ALL")
def family_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).groupBy(F.split_part("source", F.lit("-"), F.lit(1)).alias("family")).agg(F.sum("seen").alias("seen"))


@_q()
def family_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Sequential by nature: no SQL twin."""
    df = _sources(spark, d).withColumn("family", F.split_part("source", F.lit("-"), F.lit(1)))
    return learning.family_diverse(df, "source", "family", "score")


# --- invariants, client queries -----------------------------------------------------------------------------------


@_q(
    """SELECT cand_no, unnest(v) AS violation FROM (SELECT cand_no, list_filter([CASE WHEN NOT coalesce(score BETWEEN 0 AND 100, false) THEN 'score' END,
  CASE WHEN NOT coalesce(tier IN ('high', 'review'), false) THEN 'tier' END, CASE WHEN NOT coalesce(length(id) > 0, false) THEN 'id' END], lambda x: x IS NOT NULL) AS v FROM candidates)"""
)
def invariants(spark: SparkSession, d: str) -> DataFrame:
    return checks.violations(table(spark, d, "candidates"), "cand_no", [("score", F.col("score").between(0, 100)), ("tier", F.col("tier").isin("high", "review")), ("id", F.length("id") > 0)])


@_q("SELECT l_orderkey, count(*) AS n_bad FROM lineitem WHERE NOT (l_quantity > 0 AND l_discount BETWEEN 0 AND 0.1 AND l_extendedprice > 0) OR l_tax > 0.07 GROUP BY l_orderkey")
def invariants_volume(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    return df.where("NOT (l_quantity > 0 AND l_discount BETWEEN 0 AND 0.1 AND l_extendedprice > 0) OR l_tax > 0.07").groupBy("l_orderkey").agg(F.count("*").alias("n_bad"))


@_q("SELECT id, count(*) AS n_rows FROM greenhouse_postings GROUP BY id HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return checks.repeated_keys(table(spark, d, "greenhouse_postings"), "id")


def _recommend(order: str) -> str:
    return f"SELECT cand_no, tier, overall FROM (SELECT *, {_TIER} AS tier FROM {_SCORED}) WHERE tier <> 'hidden' ORDER BY {order}, cand_no LIMIT 100"


def _shown(spark: SparkSession, d: str) -> DataFrame:
    return rules.where_not(_scored(spark, d), "tier", "hidden")


@_q(_recommend("tier = 'high' DESC, overall DESC, strength DESC"))
def recommend_best(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d).orderBy((F.col("tier") == "high").desc(), F.desc("overall"), F.desc("strength"), "cand_no").limit(100).select("cand_no", "tier", "overall")


@_q(_recommend("fresh DESC, overall DESC"))
def recommend_fresh(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d).orderBy(F.desc("fresh"), F.desc("overall"), "cand_no").limit(100).select("cand_no", "tier", "overall")


@_q(f"SELECT cand_no FROM {_SCORED} WHERE contains(t, 'weekend') AND contains(t, 'remote')")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).where(F.contains("t", F.lit("weekend")) & F.contains("t", F.lit("remote"))).select("cand_no")


@_q("SELECT company, cand_no, n FROM (SELECT company, cand_no, count(*) OVER (PARTITION BY company) AS n, row_number() OVER (PARTITION BY company ORDER BY coalesce(score, -1) DESC, cand_no) AS rn FROM candidates) WHERE rn = 1")
def family_groups(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "candidates").select("company", "cand_no", "score")
    n = df.groupBy("company").agg(F.count("*").alias("n"))
    best = dedupe.best_of(df, ["company"], _order())
    return best.join(n, best.company.eqNullSafe(n.company)).select(best.company, "cand_no", "n")


@_q(
    """SELECT listing_id, string_agg(link, ' ' ORDER BY pos) AS links FROM (SELECT listing_id, link, min(pos) AS pos FROM
 (SELECT listing_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM (SELECT listing_id, list_transform(apply_options, lambda o: regexp_replace(o.link, '[?#].*$', '')) AS l FROM listings)) GROUP BY listing_id, link) GROUP BY listing_id"""
)
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The distinct links of a listing without query and fragment, in order of first sight."""
    df = table(spark, d, "listings").select("listing_id", F.posexplode(F.transform("apply_options", lambda o: F.regexp_replace(o["link"], "[?#].*$", ""))).alias("pos", "link"))
    first = df.groupBy("listing_id", "link").agg(F.min("pos").alias("pos"))
    return first.groupBy("listing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]), " ").alias("links"))


@_q("SELECT cand_no, CASE WHEN location IN ('Tokyo', '東京都') THEN 'Tokyo, Japan' WHEN location IN ('Osaka', '大阪府') THEN 'Osaka, Japan' ELSE location END AS place FROM candidates")
def place_names(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("location")
    return table(spark, d, "candidates").select("cand_no", F.when(place.isin("Tokyo", "東京都"), "Tokyo, Japan").when(place.isin("Osaka", "大阪府"), "Osaka, Japan").otherwise(place).alias("place"))


_HASH = "sha256(concat_ws(chr(31), 'policy-1', coalesce(title, ''), coalesce(company, ''), coalesce(snippet, '')))"


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.sha2(F.concat_ws("\x1f", F.lit("policy-1"), *[F.coalesce(c, F.lit("")) for c in ("title", "company", "snippet")]), 256))


@_q(f"SELECT cand_no, {_HASH} AS h FROM candidates")
def input_hash(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(table(spark, d, "candidates")).select("cand_no", "h")


@_q(f"SELECT i.intake_no, min(c.cand_no) AS cached FROM (SELECT intake_no, id, {_HASH} AS h FROM intake) i LEFT JOIN (SELECT cand_no, id, {_HASH} AS h FROM candidates) c ON i.id = c.id AND i.h = c.h GROUP BY i.intake_no")
def review_cache(spark: SparkSession, d: str) -> DataFrame:
    """Results kept under id and input hash, looked up for new rows."""
    new, old = _hashed(table(spark, d, "intake")).select("intake_no", "id", "h"), _hashed(table(spark, d, "candidates")).groupBy("id", "h").agg(F.min("cand_no").alias("cached"))
    return new.join(old, ["id", "h"], "left").groupBy("intake_no").agg(F.min("cached").alias("cached"))


@_q("SELECT coalesce(a.board, b.board) AS board, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT board, count(*) AS n FROM listings WHERE board IS NOT NULL GROUP BY board) a FULL JOIN (SELECT board, count(*) AS n FROM intake WHERE board IS NOT NULL GROUP BY board) b ON a.board = b.board")
def attempts_merge(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t, c: table(spark, d, t).where("board IS NOT NULL").groupBy("board").agg(F.count("*").alias(c))
    both = side("listings", "a").join(side("intake", "b"), "board", "full_outer")
    return both.select("board", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))


@_q(f"SELECT cand_no FROM (SELECT *, {_TIER} AS tier FROM {_SCORED}) WHERE tier <> 'hidden' ORDER BY overall DESC, cand_no LIMIT 30 OFFSET 30")
def display_window(spark: SparkSession, d: str) -> DataFrame:
    """The second window of 30 rows."""
    return _shown(spark, d).orderBy(F.desc("overall"), "cand_no").offset(30).limit(30).select("cand_no")


@_q("SELECT doc_id, CASE WHEN regexp_matches(t, '(do not|never|without) [a-z ]{0,24}(assist|automat)') THEN 'prohibited' WHEN regexp_matches(t, 'automated assistance|permissible') THEN 'allowed' ELSE 'silent' END AS status FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def policy_signal(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    status = rules.first_reason([(t.rlike("(do not|never|without) [a-z ]{0,24}(assist|automat)"), "prohibited"), (t.rlike("automated assistance|permissible"), "allowed")])
    return table(spark, d, "documents").select("doc_id", F.coalesce(status, F.lit("silent")).alias("status"))


@_q("SELECT cand_no, " + _reason([("autonomy_attention_risk = 'high'", "attention"), ("human_dependency_risk >= 60", "dependency"), ("automation_confidence BETWEEN 0 AND 39", "automation"), ("continuous_presence_risk = 'high'", "presence")]) + " AS veto FROM candidates")
def veto_ladder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", rules.first_reason([
        (F.col("autonomy_attention_risk") == "high", "attention"), (F.col("human_dependency_risk") >= 60, "dependency"),
        (F.col("automation_confidence").between(0, 39), "automation"), (F.col("continuous_presence_risk") == "high", "presence"),
    ]).alias("veto"))


@_q("SELECT DISTINCT board FROM listings WHERE board IS NOT NULL EXCEPT SELECT board FROM intake")
def unseen_boards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings").where("board IS NOT NULL").select("board").distinct().join(table(spark, d, "intake"), "board", "left_anti")


@_q("SELECT cand_no, len(list_distinct(list_transform(automation_reasons, lambda x: lower(trim(x))))) AS n_signals FROM candidates")
def distinct_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_no", F.size(F.array_distinct(F.transform("automation_reasons", lambda x: F.lower(F.trim(x))))).cast("bigint").alias("n_signals"))


@_q("SELECT jk, last_us FROM (SELECT seed.jk AS jk, max(epoch_us(seed.last_seen)) AS last_us FROM candidates WHERE seed.jk IS NOT NULL GROUP BY seed.jk) ORDER BY last_us DESC NULLS LAST, jk LIMIT 300")
def newest_seeds(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "candidates").where("seed.jk IS NOT NULL").groupBy(F.col("seed.jk").alias("jk")).agg(F.max(F.unix_micros("seed.last_seen")).alias("last_us"))
    return df.orderBy(F.desc_nulls_last("last_us"), "jk").limit(300)


@_q()
def common_postings(spark: SparkSession, d: str) -> DataFrame:
    """Two posting dialects mapped to one table."""
    return feeds.common([("ashby", feeds.from_ashby(table(spark, d, "ashby_postings"))), ("greenhouse", feeds.from_greenhouse(table(spark, d, "greenhouse_postings")))])


@_q("SELECT user_id, epoch_us(max(ts)) AS last_us, count(*) AS n_seen FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 14 DAY")
def stream_ttl_state(spark: SparkSession, d: str) -> DataFrame:
    """The time-to-live state as a stream over the events."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    stream = state.read_stream(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = state.run_to_table(state.last_seen_stream(stream, "user_id", "ts"), "ttl")
    return state.unexpired(kept, "last_seen", "2024-01-30 12:00:00", 14).select("user_id", F.unix_micros("last_seen").alias("last_us"), "n_seen")


@_q(SQL["decay_fold"])
def stream_decay_state(spark: SparkSession, d: str) -> DataFrame:
    """The decayed statistics as a stream over the events; equal to the batch version."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    stream = state.read_stream(spark, d, schema, "events.parquet").select("event_type", F.to_date("ts").alias("day"))
    return state.decayed_stream(stream, "event_type", "day", 0.82).select("event_type", "weight")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clean, score, gate, one row for each opportunity, ranked: the best 150."""
    df = _shown(spark, d).join(_gated(spark, d).where("reason IS NULL").select("cand_no"), "cand_no", "left_semi")
    key = F.concat_ws("|", X.word_key(F.coalesce("company", F.lit(""))), X.word_key(F.coalesce("title", F.lit(""))))
    best = dedupe.best_of(df.withColumn("key", key), ["key"], [F.desc("overall"), F.col("cand_no")])
    return best.orderBy((F.col("tier") == "high").desc(), F.desc("fresh"), F.desc("overall"), "cand_no").limit(150).select("cand_no", "title", "company", "tier", "overall", "fresh", "reasons")


QUERIES = {**Q, "flagship": flagship}
