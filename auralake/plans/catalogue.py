"""Queries over the driver's tables, with the SQL that says what each has to return.

Arrays are reported as text or as rows, so that any engine's results compare by value; doubles are
rounded to six places. Hand-made rows stand beside the tables where these lack a case.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake import scratch
from auralake.config import VOCABULARY
from auralake.functions import arrays, logits, polyphase, signal, subwords, text, tokens
from auralake.functions.speaker_values import SPEAKERS
from auralake.operators import chunking, feedback, metrics, models, numbering, quantiles, quantiser, speakers, vectors
from auralake.sources import ranges, shards
from auralake.sources.files import METRICS_SCHEMA
from auralake.streaming.arrivals import arrivals
from auralake.streaming.partials import finished_outputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function as the query of its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request results: an error is a failed request without an id."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("value").alias("response_time"), F.when(failed, 500).otherwise(200).alias("status"), F.when(~failed, F.col("event_id")).alias("request_id"))


_REQUESTS = "requests AS (SELECT event_id, ts, value AS response_time, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CASE WHEN event_type <> 'error' THEN event_id END AS request_id FROM events)"
_ROUND = ("avg_response_time", "min_response_time", "max_response_time", "std_response_time", "p95_response_time", "success_rate")


def _rounded(df: DataFrame, names=_ROUND) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _series_sql(every: str, source: str = "requests") -> str:
    return f"""
WITH {_REQUESTS}, bins AS (
  SELECT time_bucket(INTERVAL '{every}', ts) AS timestamp, count(request_id) AS requests_per_s, count(*) AS attempts_per_s,
    avg(response_time) AS a, min(response_time) AS lo, max(response_time) AS hi, stddev_samp(response_time) AS sd,
    quantile_cont(response_time, 0.95) AS p, avg(CASE WHEN status = 200 THEN 1.0 ELSE 0.0 END) * 100 AS ok
  FROM {source} GROUP BY 1
), spine AS (SELECT unnest(generate_series((SELECT min(timestamp) FROM bins), (SELECT max(timestamp) FROM bins), INTERVAL '{every}')) AS timestamp)
SELECT timestamp, coalesce(requests_per_s, 0) AS requests_per_s, coalesce(attempts_per_s, 0) AS attempts_per_s, round(a, 6) AS avg_response_time,
  round(lo, 6) AS min_response_time, round(hi, 6) AS max_response_time, round(sd, 6) AS std_response_time, round(p, 6) AS p95_response_time, round(ok, 6) AS success_rate
FROM spine LEFT JOIN bins USING (timestamp)"""


@query(_series_sql("10 minutes"))
def metrics_resample(spark, sf_dir):
    """The flagship: per-interval counts, response times, 95th percentile and success rate, gaps filled."""
    return _rounded(metrics.time_series(requests(spark, sf_dir), "10 minutes"))


@query(_series_sql("1 second"))
def metrics_per_second(spark, sf_dir):
    """Every second from the first request of the table to its last."""
    return _rounded(metrics.time_series(requests(spark, sf_dir)))


@query(f"""
WITH {_REQUESTS}
SELECT count(*) AS total, count(*) FILTER (WHERE status = 200) AS successes, count(*) - count(*) FILTER (WHERE status = 200) AS failures,
  round(avg(response_time) FILTER (WHERE status = 200), 6) AS avg_response_time, round(min(response_time) FILTER (WHERE status = 200), 6) AS min_response_time,
  round(max(response_time) FILTER (WHERE status = 200), 6) AS max_response_time, round(median(response_time) FILTER (WHERE status = 200), 6) AS median_response_time
FROM requests""")
def metrics_summary(spark, sf_dir):
    return _rounded(metrics.summary(requests(spark, sf_dir)), ("avg_response_time", "min_response_time", "max_response_time", "median_response_time"))


@query("""
WITH m AS (SELECT * FROM events WHERE event_type <> 'error')
SELECT round(avg(value), 6) AS avg_time_to_first_token, round(avg(value * 2), 6) AS avg_time_to_last_token, round(avg(value * 3), 6) AS avg_end_to_end_time FROM m""")
def generation_summary(spark, sf_dir):
    v = F.col("value")
    # In the order of the schema; the time end to end is optional and absent here.
    m = F.struct(F.array(v), F.array(v * 2), v, v, F.array(F.lit(1)), F.array(F.lit(2)), v * 3, F.lit(None)).cast(T.StructType.fromDDL(METRICS_SCHEMA))
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", m).alias("metrics"))
    return _rounded(metrics.generation_summary(rows), ("avg_time_to_first_token", "avg_time_to_last_token", "avg_end_to_end_time"))


@query("SELECT event_id, round((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 1e6, 6) AS relative_time FROM events")
def relative_time(spark, sf_dir):
    return metrics.relative_time(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", F.round("relative_time", 6).alias("relative_time"))


@query("""
SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') AND value IS NOT NULL GROUP BY ALL""")
def status_filter(spark, sf_dir):
    return metrics.having(table(spark, sf_dir, "events"), "event_type", ["purchase", "error"], ["value"]).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


_LITERAL_TEXTS = ["", "a,.?b..c!!", "a\t\tb", "\n\nA\r\nB ", "\xa0edge\xa0", "\x1cedge\x1f", "Mixed हिन्दी ,, Text??"]


def _with_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_LITERAL_TEXTS)], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").union(made)


def _sql_text(t: str) -> str:
    return "concat(" + ", ".join(f"chr({ord(c)})" for c in t) + ")" if t else "''"


_DOCS = "docs AS (SELECT doc_id, text FROM documents UNION ALL VALUES " + ", ".join(f"({-1 - i}, {_sql_text(t)})" for i, t in enumerate(_LITERAL_TEXTS)) + ")"
_EDGE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"
_SANITIZED = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\n+', ' ', 'g'), '[ \t]+', ' ', 'g'), '([,\.?])+', '\1', 'g'), '^{_EDGE}', ''), '{_EDGE}$', '')"


@query(f"WITH {_DOCS} SELECT doc_id, {_SANITIZED} AS text FROM docs")
def sanitize_text(spark, sf_dir):
    return _with_literals(spark, sf_dir).select("doc_id", text.sanitize(F.col("text")).alias("text"))


@query(rf"WITH {_DOCS} SELECT doc_id, regexp_replace(regexp_replace(text, '^{_EDGE}', ''), '{_EDGE}$', '') AS text FROM docs WHERE regexp_replace(text, '{_EDGE}', '', 'g') <> ''")
def prompt_lines(spark, sf_dir):
    rows = _with_literals(spark, sf_dir).select("doc_id", text.strip(F.col("text")).alias("text"))
    return rows.where("text <> ''")


@query(r"""
SELECT item_id, pos AS sentence, s AS text FROM (
  SELECT item_id, unnest(l) AS s, unnest(range(0, len(l)))::INT AS pos FROM (
    SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS l FROM benchmark))""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence", "text"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS suffix, replace(url, '/', '__') || '.csv' AS file_name,
  regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS sample_id FROM pages""")
def file_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.suffix(url).alias("suffix"), text.file_name(url).alias("file_name"), text.sample_id(url).alias("sample_id"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, format('HTTP {}', event_id) AS error, to_json({'event_id': event_id, 'kind': event_type})::VARCHAR AS record, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def log_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.stamp(F.col("ts")).alias("stamp"), text.http_error(F.col("event_id")).alias("error"), F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))).alias("record"), F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT item_id, replace(replace(text, ',', ' <comma>'), '.', ' <period>') AS marked, text AS restored FROM benchmark")
def mark_words(spark, sf_dir):
    marked = text.marks_to_words(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", marked.alias("marked"), text.words_to_marks(marked).alias("restored"))


@query("SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prompt FROM conversations")
def prompt_prefix_join(spark, sf_dir):
    return chunking.growing_prompts(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "prompt")


@query("SELECT conv_id, string_agg('<|' || role || '|>' || text || chr(10), '' ORDER BY turn, role, text) || '<|assistant|>' AS prompt FROM conversations GROUP BY conv_id")
def chat_template(spark, sf_dir):
    return chunking.chat(table(spark, sf_dir, "conversations"))


# Codes: a vector's components as codes below 2048, eight rows of eight.
_CODES = "codes AS (SELECT vec_id, list_transform(embedding, lambda x: ((CAST(floor(CAST(x AS DOUBLE) * 1e4) AS BIGINT) % 2048) + 2048) % 2048) AS a FROM embeddings)"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", signal.codes(F.col("embedding")).alias("a"))


def books_of(a: Column, rows: int = 8, frames: int = 8) -> Column:
    return F.transform(F.array(*map(F.lit, range(rows))), lambda c: F.slice(a, c * frames + 1, F.lit(frames)))


def _text_sql(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


_ENCODED = f"list_transform(range(0, 64), lambda i: a[(i % 8) * 8 + i // 8 + 1] + (i % 8) * 2048 + {VOCABULARY.audio_offset})"


@query(f"WITH {_CODES} SELECT vec_id, {_text_sql(_ENCODED)} AS ids FROM codes")
def codebook_encode(spark, sf_dir):
    return codes(spark, sf_dir).select("vec_id", as_text(tokens.encode_audio(books_of(F.col("a")))).alias("ids"))


@query(f"WITH {_CODES} SELECT vec_id, unnest(range(0, 8))::INT AS book, unnest(list_transform(range(0, 8), lambda c: {_text_sql('list_transform(range(0, 8), lambda t: a[t * 8 + c + 1] - c * 2048 - 50257)')})) AS row FROM codes")
def codebook_decode(spark, sf_dir):
    return codes(spark, sf_dir).select("vec_id", F.posexplode_outer(tokens.decode_audio(F.col("a"))).alias("book", "row")).withColumn("row", as_text(F.col("row")))


@query(f"WITH {_CODES} SELECT vec_id, true AS same FROM codes")
def codebook_roundtrip(spark, sf_dir):
    books = books_of(F.col("a"))
    return codes(spark, sf_dir).select("vec_id", (tokens.decode_audio(tokens.encode_audio(books)) == books).alias("same"))


@query(f"WITH {_CODES} SELECT vec_id, len(list_filter(a, lambda x: x >= 2048 OR x < 0)) = 0 AS valid, len(list_filter(a, lambda x: x - 1024 < 0)) = 0 AS shifted_ok FROM codes")
def codebook_valid(spark, sf_dir):
    a = books_of(F.col("a"))
    return codes(spark, sf_dir).select("vec_id", tokens.all_codes_valid(a).alias("valid"), tokens.non_negative(books_of(tokens.shift(F.col("a"), -1024))).alias("shifted_ok"))


_HAND = [(-1, []), (-2, [7]), (-3, [5, 5, 5]), (-4, [1, 2, 1, 2]), (-5, [0, 9, 9, 0]), (-6, list(range(17)))]
_HAND_SQL = "rows_ AS (SELECT vec_id, a, a[17] AS stop FROM codes UNION ALL VALUES " + ", ".join(f"({i}::BIGINT, {a}::BIGINT[], 0::BIGINT)" for i, a in _HAND) + ")"


def _hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code arrays with a stop id each, and the short, empty and repeating ones that the table lacks."""
    own = codes(spark, sf_dir).select("vec_id", F.col("a").cast("array<int>").alias("a"), F.get("a", 16).cast("int").alias("stop"))
    return own.union(spark.createDataFrame([(i, a, 0) for i, a in _HAND], "vec_id long, a array<int>, stop int"))


@query(f"WITH {_CODES}, {_HAND_SQL} SELECT vec_id, {_text_sql('CASE WHEN list_position(a, stop) > 0 THEN a[1:list_position(a, stop) - 1] ELSE a END')} AS ids FROM rows_")
def stop_truncate(spark, sf_dir):
    return _hand(spark, sf_dir).select("vec_id", as_text(tokens.until_stop(F.col("a"), F.col("stop"))).alias("ids"))


@query(f"WITH {_CODES}, {_HAND_SQL} SELECT vec_id, {_text_sql('a[11:]')} AS ids, {_text_sql('a[1:greatest(len(a) - 16, 0)]')} AS trimmed FROM rows_")
def drop_prompt(spark, sf_dir):
    a = F.col("a")
    empty = F.array().cast("array<int>")
    return _hand(spark, sf_dir).select("vec_id", as_text(tokens.without_prompt(a, F.slice(F.sequence(F.lit(1), F.lit(10)), 1, 10))).alias("ids"), as_text(tokens.with_audio_context(empty, a)).alias("trimmed"))


_T, _C, _A = 66641, 66642, 66643


@query(f"""
WITH {_CODES}, {_HAND_SQL} SELECT vec_id,
  {_text_sql(f'[{_T}]::BIGINT[] || a || [{_C}, {_A}]::BIGINT[] || [stop]')} AS tts, {_text_sql(f'[{_A}]::BIGINT[] || a || [{_C}, {_T}]::BIGINT[]')} AS asr,
  {_text_sql(f'[{_A}]::BIGINT[] || a')} AS continuation, '[text]' || vec_id || '[convert][mimi][spkr_unk]' AS written FROM rows_""")
def model_prompts(spark, sf_dir):
    a, t, c, m = F.col("a"), F.lit(_T), F.lit(_C), F.lit(_A)
    return _hand(spark, sf_dir).select("vec_id", as_text(tokens.tts_prompt(a, F.array("stop"), t, c, m)).alias("tts"), as_text(tokens.asr_prompt(a, m, c, t)).alias("asr"), as_text(tokens.continuation_prompt(a, m)).alias("continuation"), tokens.tts_prompt_text(F.col("vec_id").cast("string"), F.lit(VOCABULARY.unknown_speaker)).alias("written"))


@query(f"WITH {_CODES}, {_HAND_SQL} SELECT vec_id, {_text_sql(f'[{_T}]::BIGINT[] || a || [{_C}, {_A}]::BIGINT[]')} AS ids FROM rows_")
def staged_prompts(spark, sf_dir):
    return _hand(spark, sf_dir).select("vec_id", as_text(tokens.staged_prompt(F.col("a"), F.lit(_T), F.lit(_C), F.lit(_A))).alias("ids"))


@query(f"WITH {_CODES}, {_HAND_SQL} SELECT vec_id, {_text_sql('list_transform(list_filter(range(1, len(a) + 1), lambda i: i = 1 OR a[i] <> a[i - 1]), lambda i: a[i])')} AS ids FROM rows_")
def run_collapse(spark, sf_dir):
    return _hand(spark, sf_dir).select("vec_id", as_text(tokens.collapse_runs(F.col("a"))).alias("ids"))


@query("""
SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type GROUP BY user_id""")
def run_collapse_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    return e.select("user_id", F.array_join(tokens.collapse_runs(F.transform("l", lambda x: x["event_type"])), ",").alias("kinds"))


@query(f"WITH {_CODES} SELECT vec_id, {_text_sql('flatten(list_transform(range(1, 9), lambda i: [a[i], a[i + 8] + 1024]))')} AS ids, {_text_sql('a[1:16]')} AS two FROM codes")
def interleave2(spark, sf_dir):
    books = books_of(F.col("a"))
    return codes(spark, sf_dir).select("vec_id", as_text(tokens.interleave_two(books)).alias("ids"), as_text(F.flatten(tokens.first_two(books))).alias("two"))


@query(f"WITH {_CODES}, {_HAND_SQL} SELECT vec_id, {_text_sql('list_filter(range(0, len(a)), lambda i: CASE WHEN i % 2 = 0 THEN a[i + 1] >= 1024 ELSE a[i + 1] < 1024 END)')} AS places, {_text_sql('a[1:len(a) - len(a) % 2]')} AS even FROM rows_")
def codebook_violations(spark, sf_dir):
    a = F.col("a")
    return _hand(spark, sf_dir).select("vec_id", as_text(tokens.violations(a)).alias("places"), as_text(arrays.even_length(a)).alias("even"))


@query(f"WITH {_CODES}, {_HAND_SQL} SELECT vec_id, {_text_sql('a[4:8]')} AS middle, {_text_sql('CASE WHEN len(a) <= 3 THEN a ELSE a[len(a) - 2:] END')} AS tail, {_text_sql('a')} AS whole, {_text_sql('list_transform(a, lambda x: x * 35)')} AS scaled, {_text_sql('list_transform(a, lambda x: x + x)')} AS doubled, len(list_distinct(a))::INT AS kinds, len(a)::INT AS n FROM rows_")
def array_pieces(spark, sf_dir):
    a = F.col("a")
    return _hand(spark, sf_dir).select("vec_id", as_text(arrays.between(a, 3, 8)).alias("middle"), as_text(arrays.tail(a, 3)).alias("tail"), as_text(arrays.tail(a, 0)).alias("whole"), as_text(tokens.proportional(a, 35)).alias("scaled"), as_text(tokens.add(a, a)).alias("doubled"), arrays.distinct_count(a).alias("kinds"), F.size(a).alias("n"))


@query(f"WITH {_CODES} SELECT vec_id % 10 AS grp, {_text_sql('flatten(list(a ORDER BY vec_id))')} AS ids FROM codes GROUP BY 1")
def arrays_in_order(spark, sf_dir):
    """A tenth of the table in a row: as one text a vector, since a string for each code would fill an executor's memory."""
    rows = codes(spark, sf_dir).select((F.col("vec_id") % 10).alias("grp"), "vec_id", F.array(F.nullif(as_text(F.col("a")), F.lit(""))).alias("ids"))
    return chunking.concat_in_order(rows, "grp", "vec_id", "ids").select("grp", as_text(F.col("ids")).alias("ids"))


@query(f"WITH {_CODES} SELECT vec_id // 16 AS grp, {_text_sql('flatten(list(a[1:32] ORDER BY vec_id))')} AS book0, {_text_sql('flatten(list(a[33:64] ORDER BY vec_id))')} AS book1 FROM codes GROUP BY 1")
def books_in_order(spark, sf_dir):
    rows = codes(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("grp"), "vec_id", books_of(F.col("a"), 2, 32).alias("m"))
    return chunking.join_books_in_order(rows, "grp", "vec_id", "m").select("grp", as_text(F.get("m", 0)).alias("book0"), as_text(F.get("m", 1)).alias("book1"))


def _logit_rows(df: DataFrame, of: Column, name: str = "value") -> DataFrame:
    out = df.select("vec_id", F.posexplode(of).alias("pos", name))
    return out.withColumn(name, F.round(F.when(F.col(name) == float("-inf"), None).otherwise(F.col(name)), 6))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))


def _pos_sql(of: str, cte: str = "embeddings") -> str:
    return f"SELECT vec_id, unnest(range(0, 64))::INT AS pos, unnest({of}) AS value FROM {cte}"


@query(_pos_sql("list_transform(range(0, 64), lambda i: CASE WHEN (i >= 16 + (vec_id % 5 % 4) * 8 AND i < 24 + (vec_id % 5 % 4) * 8) OR i = 63 THEN round(CAST(embedding[i + 1] AS DOUBLE), 6) END)"))
def logits_mask(spark, sf_dir):
    mask = logits.masker(books=4, size=8, offset=16, stop=-1)
    return _logit_rows(_logits(spark, sf_dir), mask((F.col("vec_id") % 5).cast("int"), F.col("l")))


@query("""
WITH top AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l, list_reverse_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))[15] AS cut FROM embeddings),
e AS (SELECT vec_id, list_transform(l, lambda x: CASE WHEN x >= cut THEN exp((x - list_max(l)) / 0.5) ELSE 0.0 END) AS w FROM top)
""" + _pos_sql("list_transform(w, lambda x: round(x / list_sum(w), 6))", "e"))
def topk_softmax(spark, sf_dir):
    kept = _logits(spark, sf_dir).select("vec_id", logits.keep_top(F.col("l"), 15).alias("l"))
    return _logit_rows(kept, logits.softmax(F.col("l"), 0.5))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS id FROM embeddings")
def greedy_pick(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", logits.greedy(F.col("l")).alias("id"))


@query("""
WITH l AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
g AS (SELECT vec_id, i, CAST(x AS DOUBLE) / 0.8 - ln(-ln((CAST(CAST('0x' || substr(md5('7|' || vec_id || '|' || i), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)) AS s FROM l)
SELECT vec_id, string_agg(i, ',' ORDER BY s DESC, i) AS ids FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) <= 3) GROUP BY vec_id""")
def sampled_ids(spark, sf_dir):
    """Three ids of each row, drawn without replacement by the softmax of its logits."""
    return _logits(spark, sf_dir).select("vec_id", as_text(logits.gumbel_top(F.col("l"), F.col("vec_id"), 3, 0.8, 7)).alias("ids"))


@query("""
WITH two AS (SELECT a.embedding AS a, b.embedding AS b FROM embeddings a, embeddings b WHERE a.vec_id = 1 AND b.vec_id = 2),
steps AS (SELECT step, a, b FROM two, range(0, 10) s(step))
SELECT CAST(step AS INTEGER) AS step, unnest(range(0, 64))::INT AS pos, unnest(list_transform(range(1, 65), lambda i: round(step / 10 * CAST(a[i] AS DOUBLE) + (1 - step / 10) * CAST(b[i] AS DOUBLE), 6))) AS value FROM steps""")
def embedding_mix(spark, sf_dir):
    swept = vectors.sweep(table(spark, sf_dir, "embeddings"), 1, 2)
    return swept.select("step", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(_pos_sql("list_transform(range(1, 65), lambda i: CASE WHEN vec_id = 3 THEN 0.5 ELSE round(CAST(embedding[i] AS DOUBLE), 6) END)"))
def embedding_replace(spark, sf_dir):
    new = F.array_repeat(F.lit(0.5), 64)
    return _logit_rows(vectors.replace_row(_logits(spark, sf_dir), 3, new, vector="l"), F.col("l"))


@query("""
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)
""" + _pos_sql("list_transform(l, lambda x: round(x * (pow(10, -0.05) / list_max(list_transform(l, lambda y: abs(y)))), 6))", "w"))
def peak_normalize(spark, sf_dir):
    return _logit_rows(_logits(spark, sf_dir), signal.peak_normalize(F.col("l")))


@query("""
WITH """ + _CODES + """, v AS (SELECT unnest(a) AS x FROM codes), b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
h AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM v, b GROUP BY 1)
SELECT CAST(s.bin AS INTEGER) AS bin, round(lo + s.bin * ((hi - lo) / 10), 6) AS lo, round(lo + (s.bin + 1) * ((hi - lo) / 10), 6) AS hi, coalesce(n, 0) AS n FROM b, range(0, 10) s(bin) LEFT JOIN h ON s.bin = h.bin""")
def token_histogram(spark, sf_dir):
    rows = codes(spark, sf_dir).select(F.explode("a").alias("x"))
    return vectors.value_histogram(rows, "x").withColumns({"lo": F.round(F.col("lo").cast("double"), 6), "hi": F.round(F.col("hi").cast("double"), 6)})


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))


def _chunks_sql(most: int, overlap: int, early: bool) -> str:
    stride = most - overlap
    keep = f"list_filter(range(0, len(w), {stride}), lambda i: i = 0 OR i - {stride} + {most} <= len(w))" if early else f"range(0, len(w), {stride})"
    return f"""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), s AS (SELECT doc_id, w, {keep} AS starts FROM d)
SELECT doc_id, unnest(range(0, len(starts)))::INT AS chunk, unnest(list_transform(starts, lambda i: array_to_string(w[i + 1:i + {most}], ' '))) AS text FROM s"""


def _chunked(rows: DataFrame, *how) -> DataFrame:
    return chunking.chunk_rows(rows, "w", *how).select("doc_id", "chunk", F.array_join("w", " ").alias("text"))


@query(_chunks_sql(64, 16, True))
def chunk_overlap(spark, sf_dir):
    return _chunked(_words(spark, sf_dir), 64, 16)


@query(_chunks_sql(200, 0, False))
def chunk_fixed(spark, sf_dir):
    return _chunked(_words(spark, sf_dir), 200, 0, False)


@query("""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS n, len(w[1:n])::INT AS got, array_to_string(w[1:n], ' ') AS text FROM d, (SELECT unnest([10, 50, 200]) AS n)""")
def prefix_slices(spark, sf_dir):
    return chunking.prefixes(_words(spark, sf_dir), "w", [10, 50, 200]).select("doc_id", "n", F.size("w").alias("got"), F.array_join("w", " ").alias("text"))


@query("""
WITH x AS (SELECT doc_id, doc_id % 3 = 0 AS first, CAST(ceil(60 * (n_chars % 500) / (256 - CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 60 END)) AS BIGINT) AS n FROM documents)
SELECT doc_id, CAST(n + n % 2 AS INTEGER) AS n FROM x""")
def overlap_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.target_overlap(60, F.col("n_chars") % 500, F.lit(256), F.col("doc_id") % 3 == 0).alias("n"))



_SPEAKERS_SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{t}', {str({a: b for a, b, _ in SPEAKERS}[n] == t).lower()})" for i, (n, t, _) in enumerate(SPEAKERS)) + ") v(i, speaker, tag, effective))"


def _speaker_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n, _, _ in SPEAKERS), F.lit("nobody"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 14).cast("int")).alias("speaker"))


_ASKED = "asked AS (SELECT c_custkey, coalesce(d.speaker, 'nobody') AS speaker FROM customer LEFT JOIN dim d ON c_custkey % 14 = d.i)"


@query(f"WITH {_SPEAKERS_SQL}, {_ASKED} SELECT c_custkey, a.speaker, coalesce(d.tag, '[spkr_unk]') AS speaker_id FROM asked a LEFT JOIN dim d ON a.speaker = d.speaker AND d.effective")
def speaker_lookup(spark, sf_dir):
    found = speakers.with_speaker(_speaker_requests(spark, sf_dir), speakers.speakers(spark), default=VOCABULARY.unknown_speaker)
    return found.select("c_custkey", "speaker", "speaker_id")


@query(f"WITH {_SPEAKERS_SQL}, {_ASKED} SELECT c_custkey, speaker, 'unsupported speaker: ' || speaker AS reason FROM asked WHERE speaker NOT IN (SELECT speaker FROM dim)")
def speaker_reject(spark, sf_dir):
    return speakers.rejected(_speaker_requests(spark, sf_dir), speakers.speakers(spark)).select("c_custkey", "speaker", "reason")


@query(f"WITH {_SPEAKERS_SQL}, {_ASKED} SELECT d.speaker AS display_name, count(c_custkey) AS n FROM dim d LEFT JOIN asked a ON a.speaker = d.speaker WHERE effective GROUP BY 1")
def speaker_names(spark, sf_dir):
    """The names that can be asked for, and how often each was."""
    asked = _speaker_requests(spark, sf_dir).groupBy("speaker").agg(F.count("*").alias("n"))
    named = speakers.names(spark).join(asked, F.col("display_name") == F.col("speaker"), "left")
    return named.select("display_name", F.coalesce("n", F.lit(0)).alias("n"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("quality") * 2 - 1)
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("s"), F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 1_000_000_000).otherwise(0)).alias("audio_id"), vote.cast("int").alias("feedback"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id")).alias("sample_id"))


_VOTES = "votes AS (SELECT 's' || (doc_id + CASE WHEN doc_id % 11 = 0 THEN 1000000000 ELSE 0 END) AS audio_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE quality * 2 - 1 END AS INTEGER) AS feedback FROM labels), samples AS (SELECT 's' || doc_id AS id FROM documents)"


@query(f"WITH {_VOTES} SELECT audio_id, feedback FROM votes WHERE feedback IN (-1, 1) AND audio_id IN (SELECT id FROM samples)")
def feedback_valid(spark, sf_dir):
    return feedback.valid(_votes(spark, sf_dir), _samples(spark, sf_dir))


@query(f"WITH {_VOTES} SELECT audio_id, feedback, CASE WHEN audio_id NOT IN (SELECT id FROM samples) THEN 'unknown sample' ELSE 'feedback is neither -1 nor 1' END AS reason FROM votes WHERE feedback NOT IN (-1, 1) OR audio_id NOT IN (SELECT id FROM samples)")
def feedback_invalid(spark, sf_dir):
    return feedback.invalid(_votes(spark, sf_dir), _samples(spark, sf_dir)).select("audio_id", "feedback", "reason")


@query(f"WITH {_VOTES} SELECT audio_id, count(*) FILTER (WHERE feedback = 1) AS real, count(*) FILTER (WHERE feedback = -1) AS fake FROM votes GROUP BY audio_id")
def feedback_tally(spark, sf_dir):
    return feedback.tally(_votes(spark, sf_dir))


_SPEEDS = "speeds AS (SELECT doc_id, n_chars AS input_tokens, n_chars % 97 AS output_tokens, (doc_id % 5) / 10 AS t1, (doc_id % 5) / 10 + (doc_id % 7) / 4 AS t2 FROM documents)"


def _speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("input_tokens"), (F.col("n_chars") % 97).alias("output_tokens"), ((d % 5) / 10).alias("time_to_first_token"), ((d % 5) / 10 + (d % 7) / 4).alias("time_to_last_token"))


@query(f"""
WITH {_SPEEDS} SELECT doc_id, input_tokens + output_tokens AS total_tokens, round((input_tokens + output_tokens)::DOUBLE / nullif(t2, 0), 6) AS toks_per_s,
  round(output_tokens::DOUBLE / nullif(t2 - t1, 0), 6) AS gen_toks_per_s FROM speeds""")
def throughput(spark, sf_dir):
    out = metrics.throughput(_speeds(spark, sf_dir))
    return out.select("doc_id", "total_tokens", F.round("toks_per_s", 6).alias("toks_per_s"), F.round("gen_toks_per_s", 6).alias("gen_toks_per_s"))


@query(f"WITH {_SPEEDS} SELECT doc_id, output_tokens FROM speeds ORDER BY output_tokens, doc_id LIMIT 25")
def topn_by_tokens(spark, sf_dir):
    return metrics.first_by(_speeds(spark, sf_dir).select("doc_id", "output_tokens"), ["output_tokens", "doc_id"])


@query("""
WITH e AS (SELECT event_id, (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) // 1000000 AS second FROM events),
q AS (SELECT *, least(0.5 + floor(second / 360) * 0.5, 5.0) AS qps FROM e)
SELECT event_id, CAST(second AS BIGINT) AS second, round(qps, 6) AS qps, round(1 / qps, 6) AS delay FROM q""")
def qps_schedule(spark, sf_dir):
    """The rate that a load test has planned for the second of each request."""
    rows = metrics.relative_time(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", F.floor("relative_time").alias("second"))
    rows = rows.withColumn("qps", metrics.rate_at(F.col("second"), 0.5, 5.0, 0.5, 360))
    return rows.select("event_id", "second", F.round("qps", 6).alias("qps"), F.round(1 / F.col("qps"), 6).alias("delay"))


@query("SELECT count(*) AS samples, CAST(sum(vec_id % 9) AS BIGINT) AS frames FROM embeddings")
def dataset_totals(spark, sf_dir):
    """Samples of 0 to 8 frames."""
    cut = F.transform(books_of(F.col("a")), lambda book: F.slice(book, F.lit(1), (F.col("vec_id") % 9).cast("int")))
    return metrics.dataset_totals(codes(spark, sf_dir).select(cut.alias("codes")))


@query("SELECT event_id // 256 AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def batched(spark, sf_dir):
    rows = metrics.batches(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return rows.select("batch", F.size("rows").cast("long").alias("n"), F.get("rows", 0)["event_id"].alias("first"), F.element_at("rows", -1)["event_id"].alias("last"))


@query("SELECT event_id, event_id AS total FROM events WHERE event_type <> 'view'")
def finished_only(spark, sf_dir):
    from auralake.streaming.streams import finished

    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("total"), (F.col("event_type") != "view").alias("finished"))
    return finished(e).drop("finished")


@query("SELECT event_id, 'v' || (event_id % 2) AS mode, event_id % 3 AS level FROM events")
def settings_merge(spark, sf_dir):
    base = F.create_map(F.lit("mode"), F.lit("none"), F.lit("level"), (F.col("event_id") % 3).cast("string"))
    update = F.create_map(F.lit("mode"), F.concat(F.lit("v"), F.col("event_id") % 2))
    merged = table(spark, sf_dir, "events").select("event_id", arrays.merge_settings(base, update).alias("m"))
    return merged.select("event_id", F.element_at("m", "mode").alias("mode"), F.element_at("m", "level").cast("long").alias("level"))


@query("""
SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS q0, round(quantile_cont(value, 0.95), 6) AS q1, round(quantile_cont(value, 0.999), 6) AS q2
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def quantiles_by_kind(spark, sf_dir):
    found = quantiles.exact_quantiles(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.999], ["event_type"])
    return _rounded(found, ("q0", "q1", "q2"))


_GAMMA = (1 + quantiles.ERROR) / (1 - quantiles.ERROR)


@query(f"""
WITH b AS (SELECT date_trunc('day', ts) AS day, value, CASE WHEN value = 0 THEN 0 ELSE sign(value) * (ceil(ln(abs(value)) / ln({_GAMMA!r}::DOUBLE)) + 1048576) END AS bucket FROM events WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY bucket) - 1 AS pos, count(*) OVER (PARTITION BY day) AS n FROM b)
SELECT day, p AS probability, round(CASE WHEN bucket = 0 THEN 0 ELSE sign(bucket) * exp((abs(bucket) - 1048576) * ln({_GAMMA!r}::DOUBLE)) * (2 / ({_GAMMA!r}::DOUBLE + 1)) END, 6) AS value
FROM r, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS p) WHERE pos = floor(p * (n - 1))""")
def quantile_sketches(spark, sf_dir):
    """Estimates of each day, of sketches of its hours added up."""
    hours = quantiles.sketch(table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts")), "value", ["hour"])
    days = quantiles.merge(hours.select(F.date_trunc("day", "hour").alias("day"), "bucket", "n"))
    return quantiles.estimate(days, [0.5, 0.95], ["day"]).select(F.col("day").cast("timestamp_ntz").alias("day"), "probability", F.round("value", 6).alias("value"))


@query("SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY lang, n_chars DESC, doc_id) AS BIGINT) AS number FROM documents")
def row_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return numbering.numbered(rows, ["lang", F.col("n_chars").desc(), "doc_id"], start=1, unique=True).drop("n_chars")


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS pos FROM events)
SELECT pos // 256 AS batch, count(*) AS n, string_agg(event_id, ',' ORDER BY pos) AS ids FROM r GROUP BY 1""")
def batched_by_user(spark, sf_dir):
    """Batches of exactly 256 in an order that has gaps, by users that have many events."""
    rows = metrics.batches(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id", "event_id"], unique=True)
    return rows.select("batch", F.size("rows").cast("long").alias("n"), as_text(F.transform("rows", lambda r: r["event_id"])).alias("ids"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def run_starts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return chunking.run_starts(rows, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


def _shards_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of tar shards with the table's texts, one member a language and one of JSON for each document."""
    shards.register(spark)
    path = f"{scratch.folder(spark)}/{name}-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents")
    members = F.create_map(F.lit("txt"), F.encode("text", "UTF-8"), F.lit("json"), F.encode(F.to_json(F.struct(F.col("lang"), F.col("doc_id"))), "UTF-8"))
    rows = d.select(F.concat(F.lit("set/d"), F.col("doc_id")).alias("key"), members.alias("members"))
    rows.write.format("tar_shards").option("maxsize", 1 << 26).mode("append").save(path)
    return path


_SHARDS_SQL = "SELECT doc_id, lang, sha256(text) AS sha FROM documents"


def _samples_of(rows: DataFrame) -> DataFrame:
    """doc_id and lang of the JSON member, and the hash of the text's."""
    about = F.from_json(F.decode(shards.member(F.col("members"), "json"), "UTF-8"), "lang string, doc_id long")
    return rows.select(about.alias("j"), F.sha2(shards.member(F.col("members"), "txt"), 256).alias("sha")).select("j.doc_id", "j.lang", "sha")


@query(_SHARDS_SQL)
def shard_ranges(spark, sf_dir):
    """The table's texts through tar shards, read back in ranges of a megabyte, each by a task of its own."""
    return _samples_of(ranges.read(spark, _shards_of(spark, sf_dir, "ranges"), 1 << 20))


@query(_SHARDS_SQL)
def shard_arrivals(spark, sf_dir):
    """The table's texts through tar shards that arrive as a stream."""
    path = _shards_of(spark, sf_dir, "arrivals")
    return _through(arrivals(spark, path, f"{path}-log", kind="shards"), path, _samples_of)


def _through(stream: DataFrame, path: str, of: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What a stream has given out once all that is there has gone through it."""
    out = of(stream)
    query = out.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(f"{path}-out")


@query("""
WITH t AS (SELECT conv_id, turn, length(text) AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) - 1 AS part, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id AS request, string_agg(ids, ',' ORDER BY part) AS ids, CAST(max(n) AS INTEGER) AS parts, 'finished' AS reason FROM t GROUP BY conv_id""")
def finished_parts(spark, sf_dir):
    """A conversation's turns as the parts of one output, backwards, the first of them twice, put together by state."""
    own = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    rows = rows.select(F.col("conv_id").alias("request"), (F.row_number().over(own.orderBy("turn", "chars")) - 1).alias("part"), F.array("chars").alias("ids"), F.count("*").over(own).alias("n"))
    rows = rows.select("request", "part", "ids", (F.col("part") == F.col("n") - 1).alias("finished"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    parts, path = rows.union(rows.where("part = 0")).orderBy(F.desc("part")), f"{scratch.folder(spark)}/finished-{uuid.uuid4().hex}"
    parts.write.parquet(f"{path}-in")
    stream = spark.readStream.schema(parts.schema).parquet(f"{path}-in")
    return _through(finished_outputs(stream), path).withColumn("ids", as_text(F.col("ids")))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def subword_round_trip(spark, sf_dir):
    """The texts that the ids of each document's tokens stand for."""
    import public_tokenizers

    make = subwords.shared(spark, public_tokenizers.path("byte_bpe_50k.json"))
    d = table(spark, sf_dir, "documents").select("doc_id", models.encode_text(F.col("text"), make).alias("ids"))
    return d.select("doc_id", F.sha2(models.decode_text(F.col("ids"), make).cast("binary"), 256).alias("sha"))


@query("SELECT vec_id, 4 AS codes, true AS nearer FROM embeddings")
def residual_codes(spark, sf_dir):
    """Codes of the embeddings by books that are fitted on them, and whether all books are as near as the first alone."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    books = quantiser.fit(vectors, "x", stages=4, size=16, rounds=2)
    off = lambda n: F.aggregate(F.zip_with("x", quantiser.decode(F.col("codes"), books, n), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    coded = quantiser.encode(vectors, "x", books)
    total = coded.select(F.sum(off(4)).alias("fine"), F.sum(off(1)).alias("rough"))
    return coded.crossJoin(F.broadcast(total)).select("vec_id", F.size("codes").alias("codes"), (F.col("fine") <= F.col("rough")).alias("nearer"))


@query(f"""
WITH {_CODES} SELECT vec_id // 32 AS wave, CAST(count(*) * 64 / 2 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS pieces FROM codes GROUP BY 1""")
def resampled_waves(spark, sf_dir):
    """Waveforms in pieces over rows, at half their rate: how many samples come of how many pieces."""
    rows = codes(spark, sf_dir).select(F.floor(F.col("vec_id") / 32).alias("wave"), "vec_id", F.col("a").cast("array<double>").alias("x"), F.lit(48_000).alias("rate"))
    out = polyphase.resample_pieces(rows, "wave", "vec_id", "x", "rate", 24_000, block=500).groupBy("wave").agg(F.sum(F.size("x")).alias("n"))
    return out.join(rows.groupBy("wave").agg(F.count("*").alias("pieces")), "wave")
