"""Queries over the revision history, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp.operators import revisions as R
from palimp.operators import verdicts as V
from palimp.operators import waterfall as W
from palimp.sources.tables import table

REV = """rev AS (
  SELECT DISTINCT ON (seq) book_id, key, chunk_id AS raw_chunk_id,
    coalesce(chunk_id, CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.chunk_id') END) AS chunk_id,
    stage, input_tokens, output_tokens, cost_usd, created_at, seq, content, CASE WHEN json_valid(meta) THEN meta END AS meta
  FROM revisions WHERE seq IS NOT NULL ORDER BY seq)"""
RANK = "list_position(['translate','reflect','proofread','style','verify','repair'], stage)"
NEWEST = f"""stg AS (
  SELECT *, {RANK} AS rank FROM rev WHERE chunk_id IS NOT NULL AND {RANK} > 0
  QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id, stage ORDER BY created_at DESC, seq DESC) = 1)"""
OLDEST = NEWEST.replace("created_at DESC, seq DESC", "created_at, seq")
PREF = """pref AS (
  SELECT DISTINCT book_id, chunk_id, CASE CAST(regexp_extract(chunk_id, 'ch(\\d+)', 1) AS INT) % 4 WHEN 0 THEN 'style' WHEN 1 THEN 'repair' END AS wanted
  FROM chunks WHERE chunk_id IS NOT NULL AND CAST(regexp_extract(chunk_id, 'ch(\\d+)', 1) AS INT) % 4 < 2)"""
JUDGE = """body AS (
  SELECT *, regexp_replace(regexp_replace(trim(content), '^```[^\\n]*\\n', ''), '\\n```[^\\n]*$', '') AS body FROM rev WHERE stage = 'judge'),
ver AS (
  SELECT seq, book_id, chunk_id, coalesce(json_extract_string(meta, '$.judged_stage'), 'translate') AS judged_stage,
    json_extract_string(meta, '$.run') AS run, created_at, json_valid(body) AS ok,
    CASE WHEN NOT json_valid(body) THEN 0
         WHEN json_type(body, '$.score') = 'VARCHAR' THEN coalesce(try_cast(json_extract_string(body, '$.score') AS INT), 0)
         ELSE coalesce(CAST(trunc(try_cast(json_extract_string(body, '$.score') AS DOUBLE)) AS INT), 0) END AS score,
    CASE WHEN NOT json_valid(body) THEN ['parse error']
         WHEN json_type(body, '$.issues') = 'ARRAY' THEN CAST(json_extract_string(body, '$.issues[*]') AS VARCHAR[])
         WHEN json_extract_string(body, '$.issues') IS NOT NULL THEN [json_extract_string(body, '$.issues')]
         ELSE CAST([] AS VARCHAR[]) END AS issues
  FROM body),
plain AS (SELECT * FROM ver WHERE run IS NULL)"""
GRID = """cell AS (
  SELECT book_id, chunk_id, stage, rank, md5(trim(content, ' ' || chr(10) || chr(9) || chr(13))) AS h FROM stg WHERE stage <> 'repair'),
grid AS (
  SELECT book_id, chunk_id, stage, rank, h <> lag(h) OVER (PARTITION BY book_id, chunk_id ORDER BY rank) AS changed FROM cell
  QUALIFY bool_or(stage = 'translate') OVER (PARTITION BY book_id, chunk_id))"""


def rev(spark, root):
    return table(spark, root, "revisions")


def preferences(spark, root):
    """Preferences for the chunks of every other chapter pair; there is no table of them."""
    n = F.regexp_extract("chunk_id", r"ch(\d+)", 1).try_cast("int") % 4
    wanted = F.when(n == 0, "style").when(n == 1, "repair")
    return table(spark, root, "chunks", "book_id", "chunk_id").distinct().select("book_id", "chunk_id", wanted.alias("preferred_stage")).filter("preferred_stage is not null")


def expected(spark, root):
    """Paragraphs per chunk."""
    return table(spark, root, "chunks", "book_id", "chunk_id", "para_idx").filter("chunk_id is not null").groupBy("book_id", "chunk_id").agg(F.max(F.size("para_idx")).alias("n_expected"))


def originals(spark, root):
    """The source text of every chunk: its paragraphs, joined by a line feed."""
    places = table(spark, root, "chunks", "book_id", "chunk_id", "chapter_idx", "para_idx").filter("chunk_id is not null").distinct().select("book_id", "chunk_id", "chapter_idx", F.posexplode("para_idx").alias("pos", "para_idx"))
    texts = table(spark, root, "paragraphs", "book_id", "chapter_idx", "para_idx", "text").filter("text is not null")
    held = places.join(texts, ["book_id", "chapter_idx", "para_idx"]).groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_set(F.struct("pos", "text"))).alias("ps"))
    return held.select("book_id", "chunk_id", F.concat_ws("\n", F.expr("transform(ps, x -> x.text)")).alias("original"))


ORIGINALS = """place AS (SELECT DISTINCT book_id, chunk_id, chapter_idx, para_idx AS l FROM chunks WHERE chunk_id IS NOT NULL),
placed AS (SELECT book_id, chunk_id, chapter_idx, unnest(l) AS para_idx, unnest(range(len(l))) AS pos FROM place),
orig AS (
  SELECT book_id, chunk_id, string_agg(text, chr(10) ORDER BY pos, text) AS original
  FROM (SELECT DISTINCT book_id, chunk_id, pos, text FROM placed JOIN paragraphs USING (book_id, chapter_idx, para_idx) WHERE text IS NOT NULL)
  GROUP BY book_id, chunk_id)"""
EXPECTED = "cnt AS (SELECT book_id, chunk_id, max(len(para_idx)) AS n_expected FROM chunks WHERE chunk_id IS NOT NULL GROUP BY ALL)"
#: SQL for "a fragment parses": its elements are ``p``, the only ones in these tables, and closed; no control characters.
PARSES = r"""NOT regexp_matches(regexp_replace({x}, '<p(?:\s[^<>]*)?>[^<>]*</p>', '', 'g'), '<') AND NOT regexp_matches({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f]')"""
VALID = r"""val AS (
  SELECT stg.*, n_expected,
    regexp_split_to_array(regexp_replace(regexp_replace(trim(content, ' ' || chr(10)), '^```[^\n]*\n', ''), '\n```[^\n]*$', ''), '(?m)^===PARAGRAPH\s+\d+===\s*$') AS parts
  FROM stg JOIN cnt USING (book_id, chunk_id)),
fine AS (SELECT * FROM val WHERE (len(parts) - 1 = n_expected OR (len(parts) = 1 AND n_expected = 1 AND trim(content, ' ' || chr(10) || chr(9)) <> ''))
  AND len(list_filter(CASE WHEN len(parts) = 1 THEN [content] ELSE parts[2:] END, lambda x: NOT (""" + PARSES.format(x="x") + """))) = 0)"""
OWN = "own AS (SELECT DISTINCT book_id, chunk_id, chapter_idx, para_idx AS l FROM chunks WHERE chunk_id IS NOT NULL)"
TOP = "top AS (SELECT book_id, chunk_id, max(rank) AS top FROM stg GROUP BY ALL)"


def replies_as_runs(spark, root):
    """The tables hold no measurement run: the judge replies of each provider are read as one."""
    held = table(spark, root, "completions", "completion_id", "book_id", "chunk_id", "stage", "provider", "created_at", "text").filter("stage = 'judge' and chunk_id is not null and provider is not null")
    score = F.coalesce(V.raw_score(F.col("text")), F.lit(0))
    order = F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")), "completion_id")
    return held.select("book_id", "chunk_id", F.col("provider").alias("run"), order.alias("_o"), score.alias("score")).groupBy("book_id", "chunk_id", "run").agg(F.max_by("score", "_o").alias("score"))


def w(cte: str, query: str) -> str:
    return f"WITH {cte}\n{query}"


QUERIES = {
    "stage_counts": (lambda s, r: R.stage_counts(rev(s, r)), w(REV, "SELECT stage, count(*) AS n FROM rev GROUP BY stage")),
    "stage_stats": (
        lambda s, r: R.stage_stats(rev(s, r)),
        w(REV, """SELECT stage, count(*) AS n, count(DISTINCT CASE WHEN chunk_id IS NOT NULL AND book_id IS NOT NULL THEN (book_id, chunk_id) END) AS n_chunks,
  count(*) FILTER (chunk_id IS NULL) AS n_legacy, count(DISTINCT CASE WHEN chunk_id IS NOT NULL AND book_id IS NOT NULL THEN (book_id, chunk_id) END) + count(*) FILTER (chunk_id IS NULL) AS n_total,
  round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens
FROM rev GROUP BY stage"""),
    ),
    "distinct_chunks": (
        lambda s, r: R.rows(rev(s, r), "stage", "book_id", "chunk_id").filter("chunk_id is not null").groupBy("stage").agg(F.count_distinct("book_id", "chunk_id").alias("n")),
        w(REV, "SELECT stage, count(DISTINCT (book_id, chunk_id)) AS n FROM rev WHERE chunk_id IS NOT NULL GROUP BY stage"),
    ),
    "legacy_rows": (
        lambda s, r: rev(s, r).filter("seq is not null").select("seq", "stage", "chunk_id").distinct().groupBy("stage").agg(F.count_if(F.col("chunk_id").isNull()).alias("n")),
        w(REV, "SELECT stage, count(*) FILTER (raw_chunk_id IS NULL) AS n FROM rev GROUP BY stage"),
    ),
    "stage_ids": (lambda s, r: R.chunk_ids_of(rev(s, r), "reflect"), w(REV, "SELECT DISTINCT book_id, chunk_id FROM rev WHERE stage = 'reflect' AND chunk_id IS NOT NULL")),
    "status_cost": (
        lambda s, r: R.stage_stats(rev(s, r)).filter(F.col("stage").isin(R.OVERVIEW)).agg(F.round(F.sum("cost_usd"), 5).alias("total_cost"), F.sum("n").alias("n")),
        w(REV, "SELECT round(sum(cost_usd), 5) AS total_cost, count(*) AS n FROM rev WHERE stage IN ('translate','judge','reflect','proofread','style','verify')"),
    ),
    "upsert_by_key": (
        lambda s, r: R.upsert(rev(s, r).drop("content", "meta")).select("key", "seq", "stage"),
        "SELECT key, seq, stage FROM (SELECT DISTINCT * EXCLUDE (content, meta) FROM revisions WHERE key IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, seq DESC) = 1",
    ),
    "timeline": (
        lambda s, r: R.timeline(rev(s, r)),
        w(REV, "SELECT book_id, chunk_id, CAST(row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY created_at, seq) - 1 AS INT) AS place, seq, stage FROM rev WHERE chunk_id IS NOT NULL"),
    ),
    "latest_revision": (
        lambda s, r: R.latest_of(rev(s, r), "translate").select("book_id", "chunk_id", "seq", F.md5("content").alias("digest")),
        w(f"{REV}, {NEWEST}", "SELECT book_id, chunk_id, seq, md5(content) AS digest FROM stg WHERE stage = 'translate'"),
    ),
    "clear_preview": (
        lambda s, r: R.to_clear(rev(s, r), "proofread").groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd")),
        w(REV, """SELECT stage, count(*) AS n, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd FROM rev
WHERE stage IN ('proofread','style','verify','repair','repair_verdicts') OR (stage = 'judge' AND coalesce(json_extract_string(meta, '$.judged_stage'), 'translate') IN ('proofread','style','verify','repair'))
GROUP BY stage"""),
    ),
    "clear_cascade": (
        lambda s, r: R.clear(rev(s, r), "reflect").select("seq", "stage").distinct().groupBy("stage").agg(F.count(F.lit(1)).alias("n")),
        w(REV, """SELECT stage, count(*) AS n FROM rev
WHERE NOT (stage IN ('reflect','proofread','style','verify','repair','reflect_notes','repair_verdicts') OR (stage = 'judge' AND coalesce(json_extract_string(meta, '$.judged_stage'), 'translate') IN ('reflect','proofread','style','verify','repair')))
GROUP BY stage"""),
    ),
    "cache_hits": (
        lambda s, r: R.cache_hits(table(s, r, "completions", "completion_id", "key", "stage").distinct(), rev(s, r)).groupBy("stage").agg(F.count_if("hit").alias("n_hit"), F.count_if(~F.col("hit")).alias("n_miss")),
        "SELECT stage, count(*) FILTER (key IS NOT NULL AND key IN (SELECT key FROM revisions WHERE key IS NOT NULL)) AS n_hit, count(*) FILTER (NOT coalesce(key IN (SELECT key FROM revisions WHERE key IS NOT NULL), false)) AS n_miss FROM (SELECT DISTINCT completion_id, key, stage FROM completions) GROUP BY stage",
    ),
    "waterfall_resolve": (
        lambda s, r: W.resolve(rev(s, r)).select("book_id", "chunk_id", "stage"),
        w(f"{REV}, {NEWEST}", "SELECT book_id, chunk_id, stage FROM stg QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY rank DESC) = 1"),
    ),
    "waterfall_with_preferences": (
        lambda s, r: W.resolved_texts(rev(s, r), preferences(s, r)).select("book_id", "chunk_id", "stage", "seq"),
        w(f"{REV}, {NEWEST}, {PREF}", """SELECT book_id, chunk_id, stage, seq FROM stg LEFT JOIN pref USING (book_id, chunk_id)
QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY coalesce(stage = wanted, false) DESC, rank DESC) = 1"""),
    ),
    "preferred_first": (
        lambda s, r: W.resolved_texts(rev(s, r), preferences(s, r), first=True).select("book_id", "chunk_id", "stage", "seq"),
        w(f"{REV}, {OLDEST}, {PREF}", """SELECT book_id, chunk_id, stage, seq FROM stg LEFT JOIN pref USING (book_id, chunk_id)
QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY coalesce(stage = wanted, false) DESC, rank DESC) = 1"""),
    ),
    "waterfall_before": (
        lambda s, r: W.before(rev(s, r), "style").select("book_id", "chunk_id", "stage", "seq"),
        w(f"{REV}, {NEWEST}", "SELECT book_id, chunk_id, stage, seq FROM stg WHERE rank < 4 QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY rank DESC) = 1"),
    ),
    "waterfall_valid": (
        lambda s, r: W.valid_before(rev(s, r), expected(s, r), "verify").select("book_id", "chunk_id", "stage", "seq", F.size("paragraphs").alias("n")),
        w(f"{REV}, {NEWEST}, {EXPECTED}, {VALID}", "SELECT book_id, chunk_id, stage, seq, CAST(n_expected AS INT) AS n FROM fine WHERE rank < 5 QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY rank DESC) = 1"),
    ),
    "assembly_map": (
        lambda s, r: W.assembly_map(rev(s, r), preferences(s, r)),
        w(f"{REV}, {NEWEST}, {PREF}, res AS (SELECT book_id, chunk_id, stage FROM stg LEFT JOIN pref USING (book_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY coalesce(stage = wanted, false) DESC, rank DESC) = 1)", "SELECT stage, CAST(sum(n) AS BIGINT) AS n FROM (SELECT stage, count(*) AS n FROM res GROUP BY stage UNION ALL SELECT stage, count(*) FROM rev WHERE stage = 'translate' AND chunk_id IS NULL GROUP BY stage) GROUP BY stage"),
    ),
    "assembly_reason": (
        lambda s, r: W.resolve(rev(s, r), preferences(s, r)),
        w(f"{REV}, {NEWEST}, {PREF}", """SELECT book_id, chunk_id, stage, CASE WHEN stage = wanted THEN 'preference' WHEN wanted IS NOT NULL THEN 'waterfall (preference unavailable)' ELSE 'waterfall' END AS reason
FROM stg LEFT JOIN pref USING (book_id, chunk_id)
QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY coalesce(stage = wanted, false) DESC, rank DESC) = 1"""),
    ),
    "assembled_paragraphs": (
        lambda s, r: W.assemble(table(s, r, "chunks"), rev(s, r)).select("book_id", "chapter_idx", "para_idx", "stage", F.md5("text").alias("digest")),
        w(f"{REV}, {NEWEST}, {EXPECTED}, {VALID}, {OWN}, best AS (SELECT fine.*, chapter_idx, l FROM fine JOIN own USING (book_id, chunk_id) WHERE len(parts) > 1 QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY rank DESC) = 1)",
          """SELECT book_id, chapter_idx, unnest(l) AS para_idx, stage, md5(trim(unnest(parts[2:]), ' ' || chr(10) || chr(9) || chr(13))) AS digest FROM best"""),
    ),
    "assembled_forced": (
        lambda s, r: W.assemble(table(s, r, "chunks"), rev(s, r), forced="verify").select("book_id", "chapter_idx", "para_idx", "stage", F.md5("text").alias("digest")),
        w(f"{REV}, {NEWEST}, {EXPECTED}, {VALID}, {OWN}, best AS (SELECT fine.*, chapter_idx, l FROM fine JOIN own USING (book_id, chunk_id) WHERE len(parts) > 1 AND stage = 'verify')",
          """SELECT book_id, chapter_idx, unnest(l) AS para_idx, stage, md5(trim(unnest(parts[2:]), ' ' || chr(10) || chr(9) || chr(13))) AS digest FROM best"""),
    ),
    "unassembled": (
        lambda s, r: W.unassembled(table(s, r, "chunks"), rev(s, r)),
        w(f"{REV}, {NEWEST}, {EXPECTED}, {VALID}, {OWN}", """SELECT book_id, chunk_id, CASE WHEN (book_id, chunk_id) IN (SELECT (book_id, chunk_id) FROM stg) THEN 'broken' ELSE 'missing' END AS why
FROM own WHERE (book_id, chunk_id) NOT IN (SELECT (book_id, chunk_id) FROM fine WHERE len(parts) > 1)"""),
    ),
    "unassembled_forced": (
        lambda s, r: W.unassembled(table(s, r, "chunks"), rev(s, r), forced="style"),
        w(f"{REV}, {NEWEST}, {EXPECTED}, {VALID}, {OWN}", """SELECT book_id, chunk_id, CASE WHEN (book_id, chunk_id) IN (SELECT (book_id, chunk_id) FROM stg WHERE stage = 'style') THEN 'broken' ELSE 'missing' END AS why
FROM own WHERE (book_id, chunk_id) NOT IN (SELECT (book_id, chunk_id) FROM fine WHERE stage = 'style' AND len(parts) > 1)"""),
    ),
    "rehydrated_later": (
        lambda s, r: W.rehydrated(table(s, r, "chunks"), rev(s, r), preferences(s, r), every=False),
        w(f"{REV}, {NEWEST}, {PREF}, {EXPECTED}, {VALID}, {OWN}, res AS (SELECT book_id, chunk_id, stage, rank FROM stg JOIN own USING (book_id, chunk_id) LEFT JOIN pref USING (book_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY coalesce(stage = wanted, false) DESC, rank DESC) = 1), lat AS (SELECT * FROM res WHERE stage <> 'translate')",
          """SELECT book_id, count(*) FILTER (ok) AS n_rehydrated, count(*) FILTER (NOT ok) AS n_failed
FROM (SELECT book_id, EXISTS (SELECT 1 FROM fine f WHERE f.book_id = lat.book_id AND f.chunk_id = lat.chunk_id AND f.rank BETWEEN 2 AND lat.rank AND len(parts) > 1) AS ok FROM lat) GROUP BY book_id"""),
    ),
    "translated_chunks": (
        lambda s, r: W.translated_of(table(s, r, "chunks"), rev(s, r)).select("book_id", "chunk_id"),
        w(REV, "SELECT DISTINCT book_id, chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND (book_id, chunk_id) IN (SELECT (book_id, chunk_id) FROM rev WHERE stage = 'translate' AND chunk_id IS NOT NULL)"),
    ),
    "grid_changed": (lambda s, r: W.grid(rev(s, r)), w(f"{REV}, {NEWEST}, {GRID}", "SELECT book_id, chunk_id, stage, changed FROM grid")),
    "grid_wide": (
        lambda s, r: W.grid_wide(rev(s, r), V.latest_verdicts(rev(s, r), None)),
        w(f"{REV}, {NEWEST}, {GRID}, {JUDGE}, late AS (SELECT book_id, chunk_id, score FROM plain WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY created_at DESC, seq DESC) = 1)",
          """SELECT g.*, score AS judge_score FROM (SELECT book_id, chunk_id, max(c) FILTER (stage = 'translate') AS translate, max(c) FILTER (stage = 'reflect') AS reflect,
  max(c) FILTER (stage = 'proofread') AS proofread, max(c) FILTER (stage = 'style') AS style, max(c) FILTER (stage = 'verify') AS verify
FROM (SELECT *, coalesce(CAST(changed AS VARCHAR), 'base') AS c FROM grid) GROUP BY book_id, chunk_id) g LEFT JOIN late USING (book_id, chunk_id)"""),
    ),
    "grid_totals": (
        lambda s, r: W.grid_totals(rev(s, r)),
        w(f"{REV}, {NEWEST}, {GRID}", "SELECT stage, count(*) FILTER (changed) AS n_changed, count(*) FILTER (NOT changed) AS n_unchanged, count(*) FILTER (changed IS NULL) AS n_base FROM grid GROUP BY stage"),
    ),
    "effective_source": (
        lambda s, r: W.effective_source(rev(s, r)),
        w(f"{REV}, {NEWEST}, {GRID}", "SELECT book_id, chunk_id, stage AS source FROM grid WHERE changed IS NULL OR changed QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY rank DESC) = 1"),
    ),
    "strict_missing": (
        lambda s, r: W.missing_in(rev(s, r), "verify"),
        w(REV, "SELECT DISTINCT book_id, chunk_id FROM rev t WHERE stage = 'translate' AND chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rev v WHERE v.stage = 'verify' AND v.book_id = t.book_id AND v.chunk_id = t.chunk_id)"),
    ),
    "revision_steps": (
        lambda s, r: W.steps(rev(s, r)),
        w(REV, """SELECT book_id, chunk_id, seq, stage, lag(seq) OVER o AS prev_seq, lag(md5(content)) OVER o <> md5(content) AS changed,
  CAST(length(content) - lag(length(content)) OVER o AS INT) AS delta
FROM rev WHERE chunk_id IS NOT NULL AND stage <> 'judge' WINDOW o AS (PARTITION BY book_id, chunk_id ORDER BY created_at, seq) QUALIFY prev_seq IS NOT NULL"""),
    ),
    "score_histogram": (lambda s, r: V.histogram(rev(s, r)), w(f"{REV}, {JUDGE}", "SELECT score, count(*) AS n FROM plain GROUP BY score")),
    "verdict_issues": (
        lambda s, r: V.verdicts(rev(s, r)).select("seq", "score", F.explode("issues").alias("issue")),
        w(f"{REV}, {JUDGE}", "SELECT seq, score, unnest(issues) AS issue FROM plain"),
    ),
    "strict_verdicts": (
        lambda s, r: V.verdicts(rev(s, r), lenient=False).groupBy("judged_stage", "score").agg(F.count(F.lit(1)).alias("n")),
        w(f"{REV}, {JUDGE}", "SELECT judged_stage, score, count(*) AS n FROM plain WHERE ok AND score BETWEEN 1 AND 5 GROUP BY ALL"),
    ),
    "scores_worst_first": (
        lambda s, r: V.scores(rev(s, r)).orderBy("score", "chunk_id", "seq"),
        w(f"{REV}, {JUDGE}", """SELECT seq, book_id, coalesce(chunk_id, '') AS chunk_id, score, CAST(len(issues) AS INT) AS n_issues,
  EXISTS (SELECT 1 FROM rev f WHERE f.stage = 'reflect' AND f.book_id = plain.book_id AND f.chunk_id = plain.chunk_id) AS reflected FROM plain"""),
    ),
    "scores_below": (
        lambda s, r: V.at_most(rev(s, r), 3, strict=True),
        w(f"{REV}, {JUDGE}, now AS (SELECT * FROM plain WHERE judged_stage = 'translate' AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY created_at DESC, seq DESC) = 1)", "SELECT book_id, chunk_id, score FROM now WHERE score < 3"),
    ),
    "scores_at_most": (
        lambda s, r: V.at_most(rev(s, r), 2),
        w(f"{REV}, {JUDGE}, now AS (SELECT * FROM plain WHERE judged_stage = 'translate' AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY created_at DESC, seq DESC) = 1)", "SELECT book_id, chunk_id, score FROM now WHERE score <= 2"),
    ),
    "judge_consistency": (
        lambda s, r: V.agreement(V.latest_verdicts(rev(s, r)), V.measurement_runs(rev(s, r)).unionByName(replies_as_runs(s, r))),
        w(f"""{REV}, {JUDGE}, now AS (SELECT * FROM plain WHERE judged_stage = 'translate' AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY created_at DESC, seq DESC) = 1),
rep AS (SELECT DISTINCT completion_id, book_id, chunk_id, provider, created_at, text, regexp_replace(regexp_replace(trim(text), '^```[^\\n]*\\n', ''), '\\n```[^\\n]*$', '') AS body FROM completions WHERE stage = 'judge' AND chunk_id IS NOT NULL AND provider IS NOT NULL),
got AS (SELECT *, CASE WHEN NOT coalesce(json_valid(body), false) THEN 0 WHEN json_type(body, '$.score') = 'VARCHAR' THEN coalesce(try_cast(json_extract_string(body, '$.score') AS INT), 0)
  ELSE coalesce(CAST(trunc(try_cast(json_extract_string(body, '$.score') AS DOUBLE)) AS INT), 0) END AS score FROM rep),
runs AS (SELECT book_id, chunk_id, provider AS run, score FROM got QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id, provider ORDER BY created_at DESC NULLS LAST, completion_id DESC) = 1
  UNION ALL SELECT book_id, chunk_id, run, score FROM ver WHERE run IS NOT NULL AND chunk_id IS NOT NULL AND judged_stage = 'translate' QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id, run ORDER BY created_at DESC, seq DESC) = 1)""",
          """SELECT runs.run, count(*) AS n, count(*) FILTER (runs.score = now.score) AS n_equal, CAST(sum(abs(runs.score - now.score)) AS BIGINT) AS shift,
  count(*) FILTER (runs.score <= 2 AND now.score <= 2) AS n_both, count(*) FILTER (runs.score <= 2 OR now.score <= 2) AS n_either,
  round(count(*) FILTER (runs.score <= 2 AND now.score <= 2) / nullif(count(*) FILTER (runs.score <= 2 OR now.score <= 2), 0), 6) AS jaccard
FROM runs JOIN now USING (book_id, chunk_id) GROUP BY runs.run"""),
    ),
    "chunk_originals": (
        lambda s, r: originals(s, r).select("book_id", "chunk_id", F.md5("original").alias("digest")),
        w(ORIGINALS, "SELECT book_id, chunk_id, md5(original) AS digest FROM orig"),
    ),
    "reflect_input": (
        lambda s, r: W.reflect_input(rev(s, r), originals(s, r), V.latest_verdicts(rev(s, r))).select("book_id", "chunk_id", F.length("original").alias("n_original"), F.md5("translation").alias("digest"), "score", F.size("issues").alias("n_issues")),
        w(f"{REV}, {NEWEST}, {JUDGE}, {ORIGINALS}, now AS (SELECT * FROM plain WHERE judged_stage = 'translate' AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY created_at DESC, seq DESC) = 1)",
          """SELECT book_id, chunk_id, CAST(length(original) AS INT) AS n_original, md5(stg.content) AS digest, score, CAST(coalesce(len(issues), 0) AS INT) AS n_issues
FROM orig JOIN stg USING (book_id, chunk_id) LEFT JOIN now USING (book_id, chunk_id) WHERE stg.stage = 'translate'"""),
    ),
}
