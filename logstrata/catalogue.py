"""All queries over the driver tables, with their SQL oracles.

``events`` plays a stream of timed records, ``documents`` a set of multi-line
sources (doc_id is the source), ``conversations`` and ``pages`` further texts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions import text as T
from logstrata.functions import times
from logstrata.functions.patterns import Component, Matcher, from_terms
from logstrata.operators import aggregates, compare, context, events, filters, sampling, segment, timeline
from logstrata.plans import governance, investigation
from logstrata.scratch import with_rank
from logstrata.sources.lines import count_lines, lines_of

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _ORACLES[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(_table(spark, sf_dir, "documents"), "doc_id", "text")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a one-line record of one source per user."""
    text = F.concat_ws(" ", "event_type", "props")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", F.col("event_id").alias("start_line"), F.col("event_id").alias("end_line"), text.alias("text"), "ts", F.map_from_arrays(F.array(F.lit("level")), F.array("event_type")).alias("fields"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one record of many lines."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.lit(1).cast("long").alias("start_line"), F.size(F.split("text", "\n", -1)).cast("long").alias("end_line"), "text", F.lit(None).cast("timestamp_ntz").alias("ts"), segment.no_fields().alias("fields"), "source", "lang")


TERMS = ("token", "License", "idiot", "the", "with", "worthless")
PATTERN = "|".join(TERMS)
REGEX = r"[0-9]{3}-[0-9]{4}"
_DOC_LINES = """
  SELECT doc_id AS source_id, i AS line_no, p[i] AS line FROM (
    SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
      SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p
      FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS p FROM documents)))
"""


@query(f"SELECT source_id, CAST(line_no AS BIGINT) AS line_no, line FROM ({_DOC_LINES})")
def lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query(f"SELECT source_id, count(*) AS lines FROM ({_DOC_LINES}) GROUP BY source_id")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_lines(_lines(spark, sf_dir))


@query(f"""SELECT source_id, CAST((line_no - 1) // 5 + 1 AS BIGINT) AS rec_no, CAST(min(line_no) AS BIGINT) AS start_line, CAST(max(line_no) AS BIGINT) AS end_line,
  string_agg(line, chr(10) ORDER BY line_no) AS text FROM ({_DOC_LINES}) GROUP BY source_id, (line_no - 1) // 5""")
def window_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.by_window(_lines(spark, sf_dir), 5).drop("ts", "fields")


@query(f"""WITH g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(?:The|And|Der|La)') THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_no) AS g FROM ({_DOC_LINES})),
r AS (SELECT source_id, min(line_no) AS a, max(line_no) AS b, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g GROUP BY source_id, g)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY a) AS rec_no, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, text FROM r""")
def separator_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.by_separator(_lines(spark, sf_dir), "The|And|Der|La").drop("ts", "fields")


@query("""WITH l AS (SELECT page_id AS s, unnest(range(1, len(p) + 1)) AS i, p FROM (SELECT page_id, regexp_split_to_array(html, '\\r\\n|\\n|\\r') AS p FROM pages)),
m AS (SELECT s, i, p[i] AS line, trim(regexp_replace(p[i], '\\s', ' ', 'g')) = '' AS blank FROM l WHERE NOT (i = len(p) AND p[i] = '')),
g AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY s ORDER BY i) AS g FROM m),
r AS (SELECT s, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS text FROM g WHERE NOT blank GROUP BY s, g)
SELECT s AS source_id, row_number() OVER (PARTITION BY s ORDER BY a) AS rec_no, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, text FROM r""")
def paragraph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.by_paragraph(lines_of(_table(spark, sf_dir, "pages"), "page_id", "html")).drop("ts", "fields")


@query("""SELECT event_id AS source_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS level,
  ts FROM events""")
def jsonline_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and parsed back."""
    rows = _table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), F.col("event_type").alias("level"), F.col("props").alias("msg")))
    parsed = segment.by_json(rows.select(F.col("event_id").alias("source_id"), F.lit(1).cast("long").alias("line_no"), body.alias("line")))
    return parsed.select("source_id", F.get_json_object(F.col("fields")["msg"], "$.k").cast("long").alias("k"), F.col("fields")["level"].alias("level"), "ts")


_TERM_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_HITS = f"""
  SELECT doc_id, text, source, lang, list_filter({_TERM_LIST}, lambda t: contains(text, t)) AS found FROM documents
"""
_FIRST = "list_sort(list_transform(found, lambda t: {'e': strpos(text, t) + length(t), 'n': -length(t), 't': t}))[1].t"


@query(f"""SELECT doc_id AS source_id, {_FIRST} AS term, list_sort(found) AS terms,
  list_filter(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: CASE WHEN contains(string_split(text, chr(10))[i], {_FIRST}) THEN i END), lambda x: x IS NOT NULL) AS hit_lines
FROM ({_HITS}) WHERE len(found) > 0""")
def filter_literal_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a term: the first term, all terms, and the lines of the first."""
    found = filters.hits(filters.filter_text(_documents(spark, sf_dir), PATTERN))
    return found.select("source_id", "term", "terms", "hit_lines")


@query(f"SELECT doc_id AS source_id, regexp_extract(text, '{REGEX}') AS first_match FROM documents WHERE regexp_matches(text, '{REGEX}')")
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.hits(filters.filter_text(_documents(spark, sf_dir), REGEX))
    return found.select("source_id", F.regexp_extract("text", REGEX, 0).alias("first_match"))


@query(f"SELECT source_id, CAST(line_no AS BIGINT) AS line_no, line FROM ({_DOC_LINES}) WHERE NOT regexp_matches(line, '[A-Z][a-z]+ the')")
def filter_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(~Matcher("[A-Z][a-z]+ the").matched(F.col("line")))


@query(f"SELECT doc_id AS source_id, CAST(len(text) - len(left(text, 120)) AS BIGINT) AS cut, left(text, 120) AS head FROM ({_HITS}) WHERE len(found) > 0")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.hits(filters.filter_text(_documents(spark, sf_dir), PATTERN)).withColumn("clipped", T.clip(F.col("text"), 120))
    cut = F.coalesce(F.nullif(F.regexp_extract("clipped", r"…\[\+(\d+) chars\]$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return found.select("source_id", cut.alias("cut"), F.substring("clipped", 1, 120).alias("head"))


COMPONENTS = (Component("secrets", "token|api_key"), Component("phones", REGEX), Component("insults", "idiot|worthless|scum"), Component("off", "the", effective=False))
_MATCHED_BY = f"""
  SELECT doc_id AS source_id, list_filter([CASE WHEN contains(text, 'token') OR contains(text, 'api_key') THEN 'secrets' END, CASE WHEN regexp_matches(text, '{REGEX}') THEN 'phones' END,
    CASE WHEN contains(text, 'idiot') OR contains(text, 'worthless') OR contains(text, 'scum') THEN 'insults' END], lambda x: x IS NOT NULL) AS m
  FROM documents WHERE regexp_matches(text, 'token|api_key|{REGEX}|idiot|worthless|scum|the')
"""
_COMPONENT_PATTERN = f"token|api_key|{REGEX}|idiot|worthless|scum|the"


@query(f"SELECT source_id, CASE WHEN len(m) = 0 THEN ['pattern'] ELSE m END AS matched_by FROM ({_MATCHED_BY})")
def component_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.hits(filters.filter_text(_documents(spark, sf_dir), _COMPONENT_PATTERN, COMPONENTS)).select("source_id", "matched_by")


@query(f"SELECT unnest(CASE WHEN len(m) = 0 THEN ['pattern'] ELSE m END) AS component_id, count(*) AS records FROM ({_MATCHED_BY}) GROUP BY 1")
def matched_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.hits(filters.filter_text(_documents(spark, sf_dir), _COMPONENT_PATTERN, COMPONENTS))
    return aggregates.usage(found, "matched_by", "component_id")


@query(f"SELECT unnest(found) AS term, count(*) AS records FROM ({_HITS}) GROUP BY 1")
def term_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.usage(filters.hits(filters.filter_text(_documents(spark, sf_dir), PATTERN)), "terms", "term")


SINCE, UNTIL = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)


@query("SELECT event_id, ts FROM events WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def scope_since_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where(filters.in_time(SINCE, UNTIL)).select("event_id", "ts")


@query("""WITH a AS (SELECT user_id, arg_max(ts, event_id) AS t FROM events WHERE ts IS NOT NULL GROUP BY user_id)
SELECT e.event_id, e.ts FROM events e LEFT JOIN a USING (user_id) WHERE e.ts IS NULL OR e.ts BETWEEN a.t - INTERVAL 36 HOUR AND a.t""")
def scope_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.last(_records(spark, sf_dir), "36h").select("event_id", "ts")


@query(f"""WITH l AS ({_DOC_LINES}), m AS (SELECT source_id, max(line_no) AS n FROM l GROUP BY source_id)
SELECT source_id, CAST(line_no AS BIGINT) AS line_no FROM l JOIN m USING (source_id) WHERE line_no >= n - 2""")
def scope_tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.tail(segment.by_line(_lines(spark, sf_dir)), 3).select("source_id", F.col("start_line").alias("line_no"))


@query(f"""SELECT source_id, CAST((line_no - 1) // 4 + 1 AS BIGINT) AS rec_no, CAST(min(line_no) AS BIGINT) AS start_line, CAST(max(line_no) AS BIGINT) AS end_line FROM ({_DOC_LINES})
GROUP BY source_id, (line_no - 1) // 4 HAVING max(line_no) >= 3 AND min(line_no) <= 6""")
def scope_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.by_window(_lines(spark, sf_dir), 4).where(filters.in_lines(3, 6)).select("source_id", "rec_no", "start_line", "end_line")


@query(f"""SELECT source AS source_id, count(*) AS scoped_records, count(*) FILTER (WHERE len(found) > 0) AS matched_records, count(*) AS without_time,
  round((count(*) - count(*) FILTER (WHERE len(found) > 0)) / count(*), 4) AS unmatched_ratio,
  list_filter([CASE WHEN count(*) FILTER (WHERE len(found) > 0) = 0 THEN 'no hits' END, CASE WHEN count(*) FILTER (WHERE len(found) > 0) > 200 THEN 'many hits' END,
    CASE WHEN round((count(*) - count(*) FILTER (WHERE len(found) > 0)) / count(*), 4) > 0.9 THEN 'mostly unmatched' END], lambda x: x IS NOT NULL) AS warnings
FROM ({_HITS}) GROUP BY source""")
def multi_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan over all sources, with a summary and warnings for each."""
    rows = _documents(spark, sf_dir).withColumn("source_id", F.col("source"))
    return filters.summary(filters.filter_text(rows, PATTERN))


@query("SELECT event_type, count(*) AS records, count(*) FILTER (WHERE ts IS NULL) AS unparsed, min(ts) AS first_ts, max(ts) AS last_ts, round(count(ts) / count(*), 6) AS coverage FROM events GROUP BY event_type")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.time_range(_table(spark, sf_dir, "events"), "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS records, min(event_id) AS first_seen FROM events WHERE ts IS NOT NULL GROUP BY 1")
def minute_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.minute_histogram(_table(spark, sf_dir, "events"), F.col("event_id"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS records, min(event_id) AS first_seen FROM events WHERE ts IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 60")
def minute_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest minutes of a survey."""
    return aggregates.minute_histogram(_table(spark, sf_dir, "events"), F.col("event_id"), aggregates.MAX_MINUTES)


@query("SELECT upper(event_type) AS level, count(*) AS records FROM events GROUP BY 1")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return aggregates.level_histogram(rows, T.level(F.col("text"), F.col("fields")["level"]))


# Fixed in SQL as in the column functions: times, addresses, hex, numbers, white space.
_TS = T.TIMESTAMP.replace("'", "''")


def _template_sql(text: str) -> str:
    for pattern, tag in T.TEMPLATE_ORDER:
        text = f"regexp_replace({text}, '{pattern}', '{tag}', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _hits_with_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records that mention a click, a purchase or an error."""
    return filters.hits(filters.filter_text(_records(spark, sf_dir), "click|purchase|error"))


_EVENT_HITS = f"""SELECT event_id, event_type || ' ' || props AS text, event_type AS term, ts, {_template_sql("event_type || ' ' || props")} AS template FROM events WHERE event_type IN ('click', 'purchase', 'error')"""


@query(f"""SELECT template, count(*) AS records, list_sort(list_distinct(list(term))) AS matched_terms,
  left(coalesce(arg_min(text, event_id) FILTER (WHERE event_id > f), arg_min(text, event_id)), 300) AS sample, arg_min(ts, event_id) AS first_seen, min(event_id) AS first_order
FROM (SELECT *, min(event_id) OVER (PARTITION BY template) AS f FROM ({_EVENT_HITS})) GROUP BY template""")
def template_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fold(_hits_with_order(spark, sf_dir), F.col("event_id"))


@query(f"""WITH t AS (SELECT {_template_sql('text')} AS template, count(*) AS n FROM conversations GROUP BY 1)
SELECT count(*) AS templates, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS folded_records, count(*) FILTER (WHERE n = 1) AS singletons, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS fold_ratio FROM t""")
def template_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").groupBy(T.template(F.col("text")).alias("template")).agg(F.count("*").alias("records"))
    return aggregates.fold_quality(rows)


@query(f"""WITH v AS (SELECT template, event_id, unnest(regexp_extract_all(text, '{T.NUMBER}')) AS value FROM ({_EVENT_HITS})),
c AS (SELECT template, value, count(*) AS n, min(event_id) AS f FROM v GROUP BY template, value),
o AS (SELECT template FROM ({_EVENT_HITS}) GROUP BY template HAVING count(*) >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY n DESC, f) AS position FROM c WHERE template IN (SELECT template FROM o))
SELECT template, '<NUM>' AS tag, position, value, n FROM r WHERE position <= 5""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw numbers behind templates (the texts hold no other tags)."""
    return aggregates.value_distribution(_hits_with_order(spark, sf_dir), F.col("event_id"))


_TOKENS = "list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]{4,}|[\\x{4e00}-\\x{9fff}]{2,}'))"


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]{4,}|[\\x{4e00}-\\x{9fff}]{2,}') AS ts FROM documents),
f AS (SELECT doc_id, token, min(i) AS i FROM (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS i FROM t) GROUP BY doc_id, token),
c AS (SELECT token, count(*) AS records, min({'d': doc_id, 'i': i}) AS f FROM f WHERE token NOT IN ('the', 'that') GROUP BY token ORDER BY records DESC, f LIMIT 60)
SELECT token, records FROM c WHERE records >= 3 ORDER BY records DESC, f LIMIT 20""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_terms(_table(spark, sf_dir, "documents"), F.col("doc_id"), exclude=("the", "that"))


@query(f"""WITH u AS (SELECT doc_id, left(text, 300) AS text FROM documents WHERE NOT (contains(text, 'token') OR contains(text, 'License')) ORDER BY doc_id LIMIT 200),
h AS (SELECT *, contains(text, 'tion') AS has, row_number() OVER (PARTITION BY contains(text, 'tion') ORDER BY doc_id) AS r FROM u),
k AS (SELECT *, CASE WHEN has AND r <= 3 THEN 'high_freq' ELSE 'random' END AS kind FROM h),
p AS (SELECT kind, text, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'random' THEN sha256(text) END, doc_id) AS position FROM k)
SELECT kind, position, text FROM p WHERE position <= 3""")
def unmatched_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of what a filter leaves out."""
    scoped = filters.filter_text(_documents(spark, sf_dir), "token|License")
    return aggregates.unmatched_samples(scoped, F.col("source_id"), "tion")


@query(f"""WITH t AS (SELECT {_template_sql('text')} AS template, conv_id * 1000 + turn AS o, text FROM conversations)
SELECT left(template, 500) AS template, records, first_order, CAST(NULL AS TIMESTAMP) AS first_seen, sample FROM (
  SELECT template, count(*) AS records, min(o) AS first_order, arg_min(left(trim(text), 300), o) AS sample FROM t GROUP BY template ORDER BY records DESC, template LIMIT 20)""")
def survey_top_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("o"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return aggregates.survey_templates(rows, F.col("o"))


@query()
def survey_space_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded counters per role, in the order of the turns."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("role").alias("source_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"), "text")
    return aggregates.survey_sketch(rows, "o", 50)


@query(f"""WITH l AS ({_DOC_LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY source_id) AS n FROM l WHERE line_no <= 1000),
s AS (SELECT source_id, list(length(line) ORDER BY length(line)) AS ls, count(*) FILTER (WHERE starts_with(trim(line), '{{') AND ends_with(trim(line), '}}')) AS j FROM r GROUP BY source_id)
SELECT source_id, (SELECT count(*) FROM l WHERE l.source_id = s.source_id) AS lines, ls[least(len(ls), CAST(floor(len(ls) * 0.99) AS INT) + 1)] AS p99_length, j AS json_like FROM s""")
def probe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.probe(_lines(spark, sf_dir))
    return out.withColumn("p99_length", F.col("p99_length").cast("long"))


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS rank, count(*) OVER () AS n FROM events)
SELECT event_id, event_type, rank FROM r WHERE rank < 4 OR rank >= n - 3""")
def sample_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = with_rank(_table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), [F.col("ts"), F.col("event_id")])
    return sampling.head_tail(ranked, ranked.count(), 7).select("event_id", "event_type", "rank")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS rank, count(*) OVER () AS n FROM events)
SELECT event_id, event_type, rank FROM r WHERE rank IN (SELECT i * (n - 1) // 9 FROM range(10) t(i))""")
def sample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = with_rank(_table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), [F.col("ts"), F.col("event_id")])
    return sampling.uniform(ranked, ranked.count(), 10).select("event_id", "event_type", "rank")


@query("""WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents),
p AS (SELECT * FROM r WHERE rank < 5 OR rank >= n - 5),
b AS (SELECT *, 8000 - coalesce(sum(length(text)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p)
SELECT doc_id AS source_id, rank, CASE WHEN room <= 0 THEN 'withheld' WHEN length(text) > room THEN 'clipped' ELSE 'whole' END AS state,
  CASE WHEN room > 0 THEN left(text, CAST(room AS INT)) END AS shown, CAST(length(text) - CASE WHEN room > 0 THEN least(length(text), room) ELSE 0 END AS BIGINT) AS omitted_chars FROM b""")
def sample_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = sampling.sample(_documents(spark, sf_dir).select("source_id", "text"), [F.col("source_id")])
    return picked.select("source_id", "rank", "state", "shown", "omitted_chars")


_MARKS = f"SELECT source_id, line_no AS a FROM ({_DOC_LINES}) WHERE contains(line, 'token') OR contains(line, 'License') OR contains(line, 'idiot')"
_ISLANDS = f"""
  SELECT source_id, min(lo) AS lo, max(hi) AS hi, count(*) AS marks, g AS island FROM (
    SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN max(hi) OVER w IS NULL OR max(hi) OVER w + 1 < lo THEN 1 ELSE 0 END AS new FROM (SELECT source_id, greatest(1, a - 1) AS lo, a + 1 AS hi FROM ({_MARKS}))
      WINDOW w AS (PARTITION BY source_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY source_id, g
"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.hits(filters.filter_text(segment.by_line(_lines(spark, sf_dir)), "token|License|idiot")).select("source_id", "start_line", "end_line")


@query(f"SELECT source_id, CAST(island AS BIGINT) AS island, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, marks FROM ({_ISLANDS})")
def expand_many_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one line around hits, merged where they overlap or touch."""
    return context.windows(_marks(spark, sf_dir), 1, 1)


@query(f"SELECT l.source_id, CAST(island AS BIGINT) AS island, CAST(line_no AS BIGINT) AS line_no, line_no || ': ' || line AS rendered FROM ({_DOC_LINES}) l JOIN ({_ISLANDS}) i ON l.source_id = i.source_id AND line_no BETWEEN lo AND hi")
def expand_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.expand(_lines(spark, sf_dir), context.windows(_marks(spark, sf_dir), 1, 1))


@query("""SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, source_index, ord) - 1 AS position FROM (
SELECT 0 AS source_index, 'events' AS label, ts, event_id AS ord, '[events] ' || event_type AS text FROM events
UNION ALL SELECT 1, 'orders', o_orderdate, o_orderkey, '[orders] ' || o_orderstatus FROM orders)""")
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("ord"), F.col("event_type").alias("text"))
    placed = _table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("text"))
    return timeline.positions(timeline.merged([("events", seen), ("orders", placed)]))


@query("SELECT event_id, ts, event_type, row_number() OVER (ORDER BY ts NULLS LAST, event_id) - 1 AS position FROM events")
def events_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.positions(timeline.in_order(_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")))


@query("""SELECT event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN '' ELSE event_type END AS shown_label FROM events""")
def label_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("label"))
    return context.without_repeats(rows, "label", ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "shown_label")


@query("""SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'refund') AS refunds, count(*) FILTER (WHERE value > 50) AS large,
  count(*) FILTER (WHERE event_type = 'refund') = 0 AS no_refunds FROM events""")
def assert_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and absence in one pass."""
    found = events.counts(_table(spark, sf_dir, "events"), {"errors": F.col("event_type") == "error", "refunds": F.col("event_type") == "refund", "large": F.col("value") > 50})
    return found.withColumn("no_refunds", F.col("refunds") == 0)


@query("SELECT CAST(sum(len(regexp_extract_all(text, '[Tt]he ')))  AS BIGINT) AS occurrences, sum(len(regexp_extract_all(text, '[Tt]he '))) >= 1 AS satisfied FROM documents")
def assert_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").agg(F.sum(events.occurrences(F.col("text"), "[Tt]he ")).alias("occurrences"))
    return rows.withColumn("satisfied", F.col("occurrences") >= 1)


@query("""SELECT event_id, event_type FROM events WHERE (regexp_matches(event_type, 'err|sign') AND regexp_matches(props, '"k": ?[1-3]'))""")
def event_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunction over fields and attributes."""
    rows = _table(spark, sf_dir, "events")
    shaped = rows.select("event_id", "event_type", F.lit("log_match").alias("category"), F.col("event_type").alias("name"), F.col("event_type").alias("label"), F.col("props").alias("text"), F.map_from_arrays(F.array(F.lit("props")), F.array("props")).alias("attributes"))
    return shaped.where(events.event_matches({"name": ["err", "sign"], "attributes.props": '"k": ?[1-3]'})).select("event_id", "event_type")


def _sequence_sql(steps: tuple[str, ...], within: float | None) -> str:
    """Greedy completion by correlated minima, independent of the window formulation."""
    sql = "SELECT user_id, event_id AS e0, ts AS t0, event_id AS e, ts AS t FROM events WHERE ts IS NOT NULL AND event_type = '" + steps[0] + "'"
    for step in steps[1:]:
        sql = f"""SELECT c.user_id, c.e0, c.t0, (min({{'t': n.ts, 'e': n.event_id}})).e AS e, (min({{'t': n.ts, 'e': n.event_id}})).t AS t FROM ({sql}) c
          JOIN events n ON n.user_id = c.user_id AND n.event_type = '{step}' AND (n.ts > c.t OR (n.ts = c.t AND n.event_id > c.e)) GROUP BY c.user_id, c.e0, c.t0"""
    limit = f"WHERE epoch_us(t) - epoch_us(t0) <= {int(within * 1_000_000)}" if within is not None else ""
    return f"""SELECT user_id, t0 AS start_ts, e0 AS start_id, t AS end_ts, (epoch_us(t) - epoch_us(t0)) / 1000000 AS elapsed_sec
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, e0) AS r FROM ({sql}) {limit}) WHERE r = 1"""


@query(_sequence_sql(("signup", "purchase"), None))
def assert_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events.sequence(_table(spark, sf_dir, "events"), [kind == "signup", kind == "purchase"], ["user_id"])


@query(_sequence_sql(("view", "click", "purchase"), 172800.0))
def sequence_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps within two days."""
    kind = F.col("event_type")
    return events.sequence(_table(spark, sf_dir, "events"), [kind == "view", kind == "click", kind == "purchase"], ["user_id"], 172800.0)


@query(f"""WITH h AS (SELECT doc_id, text, {_FIRST} AS term, found FROM ({_HITS}) WHERE len(found) > 0)
SELECT substring(sha1(concat_ws('|', '', 'log_match', term, doc_id, 1, len(string_split(text, chr(10))))), 1, 16) AS event_id, term AS name,
  left(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '')[1], 240) AS label FROM h""")
def event_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as events with stable ids."""
    found = filters.hits(filters.filter_text(_documents(spark, sf_dir), PATTERN))
    return events.project(found, F.col("source_id").cast("string")).select("event_id", "name", "label")


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'changed' ELSE 'same' END AS change,
  CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS fields
FROM (SELECT * FROM orders WHERE o_orderdate < DATE '1997-07-01') a FULL JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= DATE '1993-01-01') b ON a.o_orderkey = b.o_orderkey""")
def compare_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the orders: the older lacks late ones, the newer dropped early ones, and some statuses changed; every order is in one of them."""
    old, new = _versions(spark, sf_dir)
    return compare.changes(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return rows.where("o_orderdate < DATE '1997-07-01'"), rows.where("o_orderdate >= DATE '1993-01-01'").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")))


@query("SELECT o_orderkey, o_orderstatus AS was, 'X' AS now FROM orders WHERE o_orderdate < DATE '1997-07-01' AND o_orderdate >= DATE '1993-01-01' AND o_totalprice > 200000 AND o_orderstatus <> 'X'")
def outcome_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return compare.transitions(old, new, ["o_orderkey"], "o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def untested_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hypotheses, pending orders as their tests."""
    return compare.without(_table(spark, sf_dir, "customer").select("c_custkey"), _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unresolved_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return compare.having(_table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), flagged, F.col("l_orderkey") == F.col("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate < DATE '1997-07-01')")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References into the older version of the orders that it lacks."""
    old, _ = _versions(spark, sf_dir)
    return compare.without(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), old, F.col("l_orderkey") == F.col("o_orderkey"))


@query("SELECT source, min(doc_id) AS position FROM documents GROUP BY source")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.ordered_union(_table(spark, sf_dir, "documents"), "source", "doc_id")


_VOTES = "SELECT source AS candidate, count(*) FILTER (WHERE quality = 1) AS support, count(*) FILTER (WHERE quality = 0) AS against FROM documents JOIN labels USING (doc_id) GROUP BY source"


@query(f"SELECT candidate, support, against, CASE WHEN against > 3 THEN 'contradicted' WHEN support >= 15 THEN 'verified' ELSE 'proposed' END AS status FROM ({_VOTES})")
def governance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as candidates, labels as votes."""
    votes = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("candidate"), (F.col("quality") == 1).alias("supports"))
    return governance.status(votes, min_cases=15, allowed=3)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'superseded' WHEN o_orderstatus = 'O' THEN 'not_promoted' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not_reviewed'
  WHEN TIMESTAMP '1997-01-01 00:00:00' >= o_orderdate + INTERVAL 900 DAY THEN 'expired' WHEN TIMESTAMP '1997-01-01 00:00:00' >= o_orderdate + INTERVAL 450 DAY THEN 'stale' ELSE 'current' END AS validity FROM orders""")
def validity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviewed knowledge of limited life."""
    rows = _table(spark, sf_dir, "orders")
    date = F.col("o_orderdate").cast("timestamp_ntz")
    state = governance.validity(
        superseded=F.col("o_orderstatus") == "P", promoted=F.col("o_orderstatus") != "O", reviewed=F.col("o_orderpriority") != "4-NOT SPECIFIED",
        expires=date + F.expr("interval 900 days"), stale_from=date + F.expr("interval 450 days"), now=F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz"),
    )
    return rows.select("o_orderkey", state.alias("validity"))


@query("SELECT user_id, count(*) AS executions, CAST(sum(length(props)) AS BIGINT) AS chars, CAST(sum(length(props) // 3) AS BIGINT) AS tokens FROM events GROUP BY user_id")
def budget_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(F.count("*").alias("executions"), F.sum(F.length("props")).alias("chars"), F.sum(T.token_estimate(F.col("props"))).alias("tokens"))


@query("""SELECT doc_id AS source_id, 'evidence://sha256/' || sha256(text) || '#L1' || CASE WHEN len(string_split(text, chr(10))) > 1 THEN '-L' || len(string_split(text, chr(10))) ELSE '' END AS uri FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 100""")
def evidence_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.hits(filters.filter_text(_documents(spark, sf_dir), "the"))
    return context.pointers(found, F.sha2("text", 256)).select("source_id", "uri")


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN make_timestamp(2000, month(ts), day(ts), hour(ts), minute(ts), second(ts)::DOUBLE) ELSE date_trunc('second', ts) END AS stated FROM events")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in four ways, one without a year, read back."""
    rows = _table(spark, sf_dir, "events")
    kind, ts = F.col("event_id") % 4, F.col("ts")
    raw = F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "MMM d HH:mm:ss"))
    return rows.select("event_id", times.event_time(raw).alias("stated"))


@query("SELECT doc_id, substring(text, 1, 256) AS shown, coalesce(length(text) > 256, false) AS truncated, translate(coalesce(source, ''), chr(9) || chr(10) || chr(13), '   ') AS cell FROM documents")
def bounded_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").withColumn("b", T.bounded(F.col("text")))
    return rows.select("doc_id", F.col("b.value").alias("shown"), F.col("b.truncated").alias("truncated"), T.one_line(F.col("source")).alias("cell"))


@query("SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS cell FROM documents WHERE text IS NOT NULL")
def one_line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.one_line(F.col("text")).alias("cell"))


@query("""SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM (SELECT * FROM orders WHERE o_orderdate < DATE '1997-07-01') a FULL JOIN (SELECT * FROM orders WHERE o_orderdate >= DATE '1993-01-01') b ON a.o_custkey = b.o_custkey AND a.o_orderkey = b.o_orderkey""")
def link_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' links to orders in two versions."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return compare.link_changes(rows.where("o_orderdate < DATE '1997-07-01'"), rows.where("o_orderdate >= DATE '1993-01-01'"), "o_custkey", "o_orderkey")


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS source, CASE WHEN c_custkey IS NOT NULL THEN 'evidence://sha256/' || sha256(c_name) || '#L' || event_id || '-L' || (event_id + 1) END AS uri, c_custkey IS NOT NULL AS citable FROM events LEFT JOIN customer ON c_custkey = user_id""")
def run_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events cite the customer that their user is, if there is one."""
    found = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("first"), (F.col("event_id") + 1).alias("last"))
    digests = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source"), F.sha2("c_name", 256).alias("sha256"))
    return compare.run_evidence(found, digests)


@query("SELECT lang AS operation, count(*) AS runs, count(*) FILTER (WHERE quality = 1) AS clean, CAST(sum(len(string_split(source, '_'))) AS BIGINT) AS evidence, CAST(sum(toxic + CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS limits FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY lang")
def recording_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as runs, their labels as limits."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").where("source is not null and lang is not null")
    flags = F.create_map(F.lit("toxic"), F.col("toxic") == 1, F.lit("poor"), F.col("quality") == 0)
    runs = rows.select(F.col("lang").alias("operation"), F.when(F.col("quality") == 1, "ok").otherwise("partial").alias("status"), F.split("source", "_").alias("evidence"), flags.alias("flags"))
    return investigation.recording_metrics(runs)


@query("""WITH t AS (SELECT event_type AS template, event_id FROM events), n AS (SELECT template, count(*) AS c FROM t GROUP BY template ORDER BY c DESC, template LIMIT 3)
SELECT * FROM (SELECT template, row_number() OVER (PARTITION BY template ORDER BY event_id) AS position, event_id AS "order", template AS sample FROM t WHERE template IN (SELECT template FROM n)) WHERE position <= 2""")
def survey_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two records of the three commonest event types."""
    rows = _table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("text"))
    best = aggregates.survey_templates(rows, F.col("event_id"), 3)
    return aggregates.template_samples(rows, F.col("event_id"), best, 2).drop("ts")


VOCABULARY_TERMS = tuple(dict.fromkeys(a + b + c for a in ("th", "an", "er", "on") for b in ("e", "in", "tion", "ed", "a") for c in ("", "d", "s", " th", "an", "ly", "re", ".", "er", "st")))


@query(
    "WITH t(term) AS (VALUES " + ", ".join(f"('{t}')" for t in VOCABULARY_TERMS) + ") SELECT doc_id, list_sort(list(term)) AS terms, arg_min(term, (strpos(text, term) + length(term)) * 1000 - length(term)) AS term FROM documents JOIN t ON contains(text, term) GROUP BY doc_id"
)
def vocabulary_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred literal terms: all that occur, and the one that ends first."""
    rows = _documents(spark, sf_dir)
    return filters.hits(filters.filter_text(rows, from_terms(VOCABULARY_TERMS))).select(F.col("source_id").alias("doc_id"), "terms", "term")


@query("SELECT event_id, substring(sha1(concat_ws('|', strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_type, user_id, props)), 1, 16) AS stable_id FROM events")
def event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return rows.select("event_id", T.event_id(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_type"), F.col("user_id"), F.col("props")).alias("stable_id"))


@query("SELECT doc_id, length(text) // 3 AS tokens, regexp_replace(source || ' ' || lang, '[^A-Za-z0-9._-]+', '_', 'g') AS tag FROM documents")
def scalar_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.safe_tag(F.concat_ws(" ", "source", "lang")).alias("tag"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS records FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming count."""
    from logstrata.streaming.live import window_counts

    return window_counts(_table(spark, sf_dir, "events"), "1 hour", ["event_type"]).select("event_type", F.col("start").alias("hour"), "records")


@query("SELECT event_id FROM events WHERE user_id = 7 OR contains(props, '[7]')")
def pid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user as process id, in brackets or as a field."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"), F.map_from_arrays(F.array(F.lit("pid")), F.array(F.col("user_id").cast("string"))).alias("fields"))
    return rows.where(filters.of_process("7")).select("event_id")
