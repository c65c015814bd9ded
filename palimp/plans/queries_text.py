"""Queries over paragraphs, replies, glossaries and notes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp.functions import text as X
from palimp.functions.udfs import first_malformed, parse_replies, slug, unified_diff
from palimp.operators import chunking, glossary, notes, patches, repair
from palimp.operators import revisions as R
from palimp.operators import verdicts as V
from palimp.operators import waterfall as W
from palimp.plans.durable import durable
from palimp.plans.pipeline import checked
from palimp.plans.queries_revisions import EXPECTED, JUDGE, NEWEST, PARSES, REV, VALID, expected, rev, w
from palimp.sources import epub
from palimp.sources.tables import table

WORD = r"[^\s\p{Z}\x{85}]+"
PARA = "para AS (SELECT book_id, chapter_idx, para_idx, min(text) AS text FROM paragraphs WHERE book_id IS NOT NULL AND chapter_idx IS NOT NULL AND para_idx IS NOT NULL GROUP BY ALL)"
PACK = f"""{PARA},
num AS (SELECT book_id, chapter_idx, para_idx, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS n, row_number() OVER (PARTITION BY book_id, chapter_idx ORDER BY para_idx) AS i FROM para),
walk AS (
  SELECT book_id, chapter_idx, i, para_idx, n, n AS total, 1 AS chunk_no FROM num WHERE i = 1
  UNION ALL
  SELECT num.book_id, num.chapter_idx, num.i, num.para_idx, num.n, CASE WHEN walk.total + num.n > 150 THEN num.n ELSE walk.total + num.n END,
    CASE WHEN walk.total + num.n > 150 THEN walk.chunk_no + 1 ELSE walk.chunk_no END
  FROM walk JOIN num ON num.book_id = walk.book_id AND num.chapter_idx = walk.chapter_idx AND num.i = walk.i + 1),
packed AS (SELECT book_id, chapter_idx, chunk_no, list(para_idx ORDER BY para_idx) AS para_idx, CAST(sum(n) AS BIGINT) AS word_count FROM walk GROUP BY book_id, chapter_idx, chunk_no)"""
CAND = "cand AS (SELECT DISTINCT ON (cand_id) cand_id, book_id, original, translation, entry_type AS type, coalesce(gender, 'unknown') AS gender, note_text AS notes FROM note_candidates WHERE cand_id IS NOT NULL ORDER BY cand_id)"
#: The patterns of an issue, as SQL has them.
ISSUE = r"""iss AS (SELECT seq, book_id, chunk_id, unnest(issues) AS raw, unnest(range(len(issues))) + 1 AS n FROM plain),
cut AS (SELECT *, nullif(lower(regexp_extract(raw, '(?i)^\s*([a-z_]+)\s*[:/]', 1)), '') AS category, try_cast(nullif(regexp_extract(raw, '(?i)\bp\.\s*(\d+)', 1), '') AS INT) AS paragraph,
  nullif(trim(regexp_extract(raw, '«([^«»]{2,})»\s*(?:→|->)\s*«([^«»]+)»', 1)), '') AS old,
  CASE WHEN regexp_matches(raw, '«([^«»]{2,})»\s*(?:→|->)\s*«([^«»]+)»') THEN trim(regexp_extract(raw, '«([^«»]{2,})»\s*(?:→|->)\s*«([^«»]+)»', 2)) END AS new FROM iss)"""
NOW = "now AS (SELECT * FROM plain WHERE judged_stage = 'translate' AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY created_at DESC, seq DESC) = 1)"
PROPOSE = r"""txt AS (SELECT book_id, chunk_id, CASE WHEN len(parts) = 1 THEN [trim(content, ' ' || chr(10))] ELSE list_transform(parts[2:], lambda x: trim(x, ' ' || chr(10))) END AS ps
  FROM fine QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY rank DESC) = 1),
met AS (SELECT cut.*, ps, CASE WHEN paragraph BETWEEN 1 AND len(ps) THEN ps[paragraph] END AS here FROM (SELECT * FROM cut WHERE seq IN (SELECT seq FROM now)) cut JOIN txt USING (book_id, chunk_id)),
prop AS (SELECT *, CASE WHEN category IS NULL THEN 'no_category' WHEN category NOT IN ('grammar', 'markup', 'accuracy') THEN 'out_of_scope' WHEN paragraph IS NULL THEN 'no_paragraph'
  WHEN NOT paragraph BETWEEN 1 AND len(ps) THEN 'bad_paragraph' WHEN old IS NULL OR new IS NULL THEN 'no_pair' WHEN old = new THEN 'no_op'
  WHEN length(replace(here, old, '')) = length(here) THEN 'quote_absent' WHEN (length(here) - length(replace(here, old, ''))) > length(old) THEN 'quote_ambiguous' END AS skip FROM met)"""


def paragraphs(s, r):
    return chunking.distinct_paragraphs(table(s, r, "paragraphs", "book_id", "chapter_idx", "para_idx", "text"))


def candidates(s, r):
    return glossary.entries(table(s, r, "note_candidates"))


def valid_texts(s, r):
    return W.valid_before(rev(s, r), expected(s, r)).select("book_id", "chunk_id", "paragraphs")


def proposals(s, r):
    return repair.propose(V.latest_verdicts(rev(s, r)), valid_texts(s, r))


def vettings(found):
    """There is no table of vetting replies: of a chunk's candidates every third, from the first, is accepted,
    the next rejected, and on the next there is no verdict."""
    verdict = F.format_string('{"n": %d, "verdict": "%s"}', F.col("place"), F.when(F.col("place") % 3 == 1, "accept").otherwise("reject"))
    given = found.filter("skip is null").groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_list(F.when(F.col("place") % 3 > 0, F.struct("place", verdict.alias("v"))))).alias("vs"))
    return given.select("book_id", "chunk_id", F.concat(F.lit("["), F.array_join(F.transform("vs", lambda x: x["v"]), ", "), F.lit("]")).alias("reply"))


def _vetted(s, r):
    found = durable(proposals(s, r))
    return repair.vet(found.filter("skip is null"), repair.read_vetting(vettings(found)).filter("readable"))


def _repaired(s, r):
    found = durable(proposals(s, r))
    return repair.stage_rows(found, vettings(found), valid_texts(s, r))


def _legacy(s, r):
    held = W.by_stage(rev(s, r), "content", "meta", stages=["repair"]).select("book_id", "chunk_id", F.inline("held"))
    return repair.legacy(held, proposals(s, r), expected(s, r))


def _series(s, r):
    """Books are promoted, in order, into the series of their target language."""
    langs = table(s, r, "books", "book_id", F.col("target_lang").alias("series"))
    return candidates(s, r).join(langs, "book_id")


def _promote(s, r):
    every = _series(s, r)
    known = every.filter("cand_id % 5 = 0").select("series", "original", "translation", F.col("cand_id").alias("pos"))
    book = every.filter("cand_id % 5 <> 0").withColumn("pos", F.col("cand_id"))
    return glossary.promote(book, known, F.col("gender") != "unknown").select("cand_id", "series", "original", "outcome", "series_translation")


def _merged(s, r):
    every = _series(s, r).filter("original is not null")
    known = every.filter("cand_id % 5 = 0").select("series", "original", "translation", "type", F.col("cand_id").alias("pos"))
    book = every.filter("cand_id % 5 <> 0").withColumn("pos", F.col("cand_id"))
    return glossary.merged(book, known, F.col("gender") != "unknown")


def proofread(s, r):
    return table(s, r, "completions").filter("stage = 'proofread'").select("completion_id", "text", "user_prompt").dropDuplicates(["completion_id"])


def prompts(replies):
    """The marked paragraphs of the prompts of replies."""
    return replies.select("completion_id", F.posexplode(X.split_markers(F.col("user_prompt"))).alias("i", "text")).select("completion_id", (F.col("i") + 1).alias("p"), "text")


def _patched(s, r, run=patches.apply_patches):
    replies = proofread(s, r)
    return run(patches.read_replies(replies, "completion_id", "text"), prompts(replies), "completion_id")


def _borrowed(s, r):
    """Paragraphs of translations that carry a sentence of another paragraph of their prompt."""
    replies = table(s, r, "completions", "completion_id", "stage", "text", "user_prompt").filter("stage in ('translate', 'reflect')").distinct()
    given = prompts(replies)
    own = replies.select("completion_id", F.posexplode(X.split_markers(F.col("text"))).alias("at", "after")).withColumn("p", F.col("at") + 1)
    met = own.join(given.withColumnRenamed("text", "before"), ["completion_id", "p"], "left")
    return patches.borrowed(met, given, "completion_id").select("completion_id", "p", "other").distinct()


def _texts(s, r):
    return W.per_stage(rev(s, r))


def _cached(s, r):
    """Requests answered from the revisions, each with whether the stored reply can still be used."""
    asked = table(s, r, "completions", "completion_id", "key", "stage").filter("key is not null and stage in ('translate', 'reflect')").distinct()
    held = R.rows(rev(s, r), "key", "book_id", "chunk_id", "content", stages=["translate", "reflect"]).filter("key is not null").dropDuplicates(["key"])
    met = asked.join(held.drop("stage"), "key").join(expected(s, r), ["book_id", "chunk_id"])
    return checked(met, "content").select("completion_id", "stage", F.when(F.col("error") == "", "cached").otherwise("cached_broken").alias("outcome"))


def _glossary_replies(s, r):
    """There is no table of glossary replies: a book's candidates make one, in which the type of every seventh is
    unknown, every third overrides, and the marks of some books are lost."""
    kind = F.when(F.col("cand_id") % 7 == 0, "beast").otherwise(F.col("type"))
    entry = F.struct("cand_id", F.struct("original", "translation", kind.alias("type"), "gender", "notes", (F.col("cand_id") % 3 == 0).alias("override")).alias("e"))
    held = candidates(s, r).filter("book_id is not null").groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    start, end = F.concat(F.lit("s"), "book_id"), F.concat(F.lit("e"), "book_id")
    reply = F.struct(F.when(F.col("book_id") % 5 != 0, start).alias("bookstart"), "entries", F.when(F.col("book_id") % 4 != 0, end).alias("bookend"))
    replies = held.select("book_id", F.concat(F.lit("Here it is:\n```json\n"), F.to_json(reply), F.lit("\n```")).alias("reply"), start.alias("bookstart"), end.alias("bookend"))
    return glossary.read_replies(replies, "book_id", "reply")


def book():
    return F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("book_id")


#: Every paragraph once, with what an archive made of the tables holds; ``place`` and ``n`` are what reading finds.
HELD = r"""bok AS (SELECT * FROM books),
par AS (SELECT book_id, chapter_idx, para_idx, arg_min(tag, text) AS tag, min(text) AS text FROM paragraphs WHERE book_id IS NOT NULL AND chapter_idx IS NOT NULL AND para_idx IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
pla AS (SELECT par.*, dense_rank() OVER (PARTITION BY book_id ORDER BY chapter_idx) - 1 AS place FROM par WHERE book_id IN (SELECT book_id FROM books)),
red AS (SELECT *, row_number() OVER (PARTITION BY book_id, place ORDER BY para_idx) - 1 AS n, len(regexp_extract_all(text, '[^\s\p{Z}\x{85}]+')) AS words FROM pla WHERE regexp_matches(text, '[^\s\p{Z}\x{85}]'))"""


def _archives(s, r):
    """The tables hold no archives: each book is made into one."""
    keyed = table(s, r, "paragraphs", "book_id", "chapter_idx", "para_idx", "tag", "text").filter("book_id is not null and chapter_idx is not null and para_idx is not null and text is not null")
    once = keyed.groupBy("book_id", "chapter_idx", "para_idx").agg(F.min_by("tag", "text").alias("tag"), F.min("text").alias("text"))
    return epub.build_archives(table(s, r, "books"), once)


def _rewritten(s, r):
    """Every paragraph of every archive replaced by its text without capitals, and read again."""
    held = _archives(s, r)
    texts = epub.read_paragraphs(held).select("path", "chapter_idx", "para_idx", F.concat(F.lit("<"), "tag", F.lit(">"), X.escape_ampersands(F.lower("text")), F.lit("</"), "tag", F.lit(">")).alias("xhtml"))
    return epub.read_paragraphs(epub.translate_archives(held, texts, "xx").select("path", "content"))


HEADS = {"FFD8FFE000104A46": "image/jpeg", "89504E470D0A1A0A00": "image/png", "52494646000000005745425056503820": "image/webp", "52494646000000005741564500": None, "474946383961": "image/gif", "474946383761": "image/gif", "424D00": "image/bmp", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "25504446": None}
PATHS = ["OEBPS/./text/../images/{}.xhtml#p1", "{}//a/../../b.xhtml?x=1", "../../{}.png", "a/b/c/../../{}/./d.html?q#f"]
OUTCOME = r"""rep AS (SELECT DISTINCT completion_id, text, user_prompt FROM completions WHERE stage = 'proofread'),
obj AS (SELECT *, regexp_extract_all(text, '\{"p":\s*\d+,\s*"text":\s*"(?:[^"\\]|\\.)*"\}') AS objs,
  coalesce(regexp_matches(trim(text), '(?i)^`*\s*NO[_ ]?CHANGES\s*`*$') OR (NOT contains(text, '[') AND regexp_matches(text, '(?is)```[^\n]*\n\s*`*\s*NO[_ ]?CHANGES\s*`*\s*```')), false) AS none FROM rep),
outc AS (SELECT completion_id, text, user_prompt, CASE WHEN text IS NULL THEN 'rejected' WHEN none THEN 'no_changes' WHEN len(objs) > 0 THEN 'patches' WHEN regexp_matches(text, '\[\s*\]') THEN 'no_changes' ELSE 'rejected' END AS outcome,
  CASE WHEN none OR text IS NULL THEN [] ELSE objs END AS objs FROM obj)"""
PATCHED = OUTCOME + r""",
giv AS (SELECT completion_id, outcome, objs, list_transform(regexp_split_to_array(user_prompt, '(?m)^===PARAGRAPH\s+\d+===\s*$')[2:], lambda x: trim(x, ' ' || chr(10))) AS ps FROM outc),
pat AS (SELECT completion_id, ps, unnest(objs) AS o, unnest(range(len(objs))) AS pos FROM giv WHERE outcome = 'patches' AND len(ps) > 0),
pat2 AS (SELECT completion_id, ps, pos, CAST(json_extract_string(o, '$.p') AS INT) AS p, trim(json_extract_string(o, '$.text')) AS after FROM pat),
pat3 AS (SELECT *, ps[p] AS before, bool_or(p NOT BETWEEN 1 AND len(ps)) OVER (PARTITION BY completion_id) AS bad FROM pat2),
sen AS (SELECT completion_id, other, unnest(string_split(regexp_replace(t, '([.!?…»]) ', '\1' || chr(31), 'g'), chr(31))) AS s FROM (
  SELECT completion_id, unnest(range(len(ps))) + 1 AS other, trim(regexp_replace(regexp_replace(unnest(ps), '<[^>]+>', ' ', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g')) AS t FROM giv)),
pat4 AS (SELECT *, trim(regexp_replace(regexp_replace(after, '<[^>]+>', ' ', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(before, '<[^>]+>', ' ', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g')) AS b FROM pat3),
ver2 AS (SELECT *, CASE WHEN bad THEN 'out_of_range' WHEN regexp_matches(before, '^\s*(?:<[^>]+>\s*)*[—–]\s') AND regexp_matches(after, '^\s*(?:<[^>]+>\s*)*«') THEN 'dash'
  WHEN NOT (""" + PARSES.format(x="after") + r""") THEN 'malformed'
  WHEN EXISTS (SELECT 1 FROM sen WHERE sen.completion_id = pat4.completion_id AND sen.other <> pat4.p AND length(s) >= 40 AND contains(pat4.a, s) AND NOT coalesce(contains(pat4.b, s), false)) THEN 'borrowed' ELSE 'accepted' END AS v FROM pat4),
ver3 AS (SELECT *, CASE WHEN v <> 'accepted' THEN v WHEN pos = max(CASE WHEN v = 'accepted' THEN pos END) OVER (PARTITION BY completion_id, p) THEN 'applied' ELSE 'overridden' END AS verdict FROM ver2)"""
FOLD = r"""cand AS (SELECT *, row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY n) AS place FROM prop WHERE skip IS NULL),
acc AS (SELECT *, row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY n) AS k FROM cand WHERE place % 3 = 1),
fold AS (SELECT DISTINCT book_id, chunk_id, 0 AS k, ps, 0 AS n_applied FROM acc
  UNION ALL SELECT f.book_id, f.chunk_id, f.k + 1, CASE WHEN length(f.ps[a.paragraph]) - length(replace(f.ps[a.paragraph], a.old, '')) = length(a.old) THEN list_transform(f.ps, lambda x, i: CASE WHEN i = a.paragraph THEN replace(x, a.old, a.new) ELSE x END) ELSE f.ps END,
    f.n_applied + CASE WHEN length(f.ps[a.paragraph]) - length(replace(f.ps[a.paragraph], a.old, '')) = length(a.old) THEN 1 ELSE 0 END
  FROM fold f JOIN acc a ON a.book_id = f.book_id AND a.chunk_id = f.chunk_id AND a.k = f.k + 1),
done AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY k DESC) = 1)"""


QUERIES = {
    "word_totals": (
        lambda s, r: paragraphs(s, r).groupBy("book_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.count_distinct("chapter_idx").alias("chapters")),
        w(PARA, f"SELECT book_id, CAST(sum(coalesce(len(regexp_extract_all(text, '{WORD}')), 0)) AS BIGINT) AS words, count(DISTINCT chapter_idx) AS chapters FROM para GROUP BY book_id"),
    ),
    "book_word_check": (
        lambda s, r: table(s, r, "books", "book_id", "word_count").join(paragraphs(s, r).groupBy("book_id").agg(F.sum(X.word_count(F.col("text"))).alias("words")), "book_id").select("book_id", (F.col("word_count") == F.col("words")).alias("matches")),
        w(PARA, f"SELECT book_id, any_value(word_count) = sum(coalesce(len(regexp_extract_all(text, '{WORD}')), 0)) AS matches FROM books JOIN para USING (book_id) GROUP BY book_id"),
    ),
    "chunk_pack": (
        lambda s, r: chunking.with_ids(chunking.pack(table(s, r, "paragraphs"))).select("book_id", "chunk_id", "para_idx", "word_count"),
        "WITH RECURSIVE " + PACK + " SELECT book_id, format('ch{:02d}_c{:02d}', chapter_idx + 1, chunk_no) AS chunk_id, para_idx, word_count FROM packed",
    ),
    "chunk_overlap": (
        lambda s, r: chunking.with_overlap(chunking.with_ids(chunking.pack(table(s, r, "paragraphs")))).select("book_id", "chunk_id", "prev_overlap", "next_overlap"),
        "WITH RECURSIVE " + PACK + """ SELECT book_id, format('ch{:02d}_c{:02d}', chapter_idx + 1, chunk_no) AS chunk_id,
  coalesce(lag(para_idx) OVER o, [])[-1:] AS prev_overlap, coalesce(lead(para_idx) OVER o, [])[1:1] AS next_overlap FROM packed WINDOW o AS (PARTITION BY book_id, chapter_idx ORDER BY chunk_no)""",
    ),
    "chapter_texts": (
        lambda s, r: table(s, r, "extracted_chapters").filter(F.col("text").rlike(r"(?U)\S")).select("book_id", "pos", F.md5("text").alias("h"), F.length("text").alias("n")).distinct().groupBy("book_id").agg((F.sum("n") + 2 * (F.count(F.lit(1)) - 1)).cast("int").alias("n_chars"), F.count(F.lit(1)).cast("int").alias("n_chapters")),
        "SELECT book_id, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS INT) AS n_chars, CAST(count(*) AS INT) AS n_chapters FROM (SELECT DISTINCT book_id, pos, text FROM extracted_chapters WHERE regexp_matches(text, '[^\\s\\p{Z}\\x{85}]')) GROUP BY book_id",
    ),
    "html_paragraphs": (
        lambda s, r: table(s, r, "paragraphs", "tag", "xhtml").distinct().groupBy("tag").agg(F.count_if(F.regexp_replace("xhtml", "<[^>]*>", "").rlike(r"(?U)\S")).alias("n_translatable"), F.count_if(F.col("xhtml").isNull()).alias("n_null")),
        "SELECT tag, count(*) FILTER (regexp_matches(regexp_replace(xhtml, '<[^>]*>', '', 'g'), '[^\\s\\p{Z}\\x{85}]')) AS n_translatable, count(*) FILTER (xhtml IS NULL) AS n_null FROM (SELECT DISTINCT tag, xhtml FROM paragraphs) GROUP BY tag",
    ),
    "plain_text": (
        lambda s, r: table(s, r, "paragraphs", "xhtml").filter("xhtml is not null").distinct().select(F.md5("xhtml").alias("id"), X.plain_text(F.col("xhtml")).alias("plain")),
        "SELECT DISTINCT md5(xhtml) AS id, trim(regexp_replace(regexp_replace(xhtml, '<[^>]+>', ' ', 'g'), '[\\s\\p{Z}\\x{85}]+', ' ', 'g')) AS plain FROM paragraphs WHERE xhtml IS NOT NULL",
    ),
    "escape_amp": (
        lambda s, r: table(s, r, "documents", "doc_id", "text").filter(F.col("text").contains("&")).select("doc_id", F.md5(X.escape_ampersands(F.col("text"))).alias("digest")),
        "SELECT doc_id, md5(replace(regexp_replace(replace(text, '&', chr(1)), chr(1) || '((?:amp|lt|gt|quot|apos|#\\d+|#x[0-9a-fA-F]+);)', '&\\1', 'g'), chr(1), '&amp;')) AS digest FROM documents WHERE contains(text, '&')",
    ),
    "split_markers": (
        lambda s, r: _texts(s, r).select("seq", F.size(X.split_markers(F.col("content"))).alias("n"), F.md5(F.concat_ws("\x1f", X.split_markers(F.col("content")))).alias("digest")).filter("n > 0"),
        w(f"{REV}, {NEWEST}", r"""SELECT seq, CAST(len(parts) - 1 AS INT) AS n, md5(list_aggregate(list_transform(parts[2:], lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), 'string_agg', chr(31))) AS digest
FROM (SELECT seq, regexp_split_to_array(regexp_replace(regexp_replace(trim(content, ' ' || chr(10)), '^```[^\n]*\n', ''), '\n```[^\n]*$', ''), '(?m)^===PARAGRAPH\s+\d+===\s*$') AS parts FROM stg) WHERE len(parts) > 1"""),
    ),
    "marker_round_trip": (
        lambda s, r: _texts(s, r).withColumn("ps", X.split_markers(F.col("content"))).filter("ps is not null").agg(F.count_if(X.split_markers(X.join_markers(F.col("ps"))) == F.col("ps")).alias("n_same"), F.count(F.lit(1)).alias("n")),
        w(f"{REV}, {NEWEST}", "SELECT count(*) AS n_same, count(*) AS n FROM stg WHERE regexp_matches(content, '(?m)^===PARAGRAPH\\s+\\d+===\\s*$')"),
    ),
    "no_changes": (
        lambda s, r: proofread(s, r).groupBy(F.coalesce(X.is_no_changes(F.col("text")), F.lit(False)).alias("no_changes")).agg(F.count(F.lit(1)).alias("n")),
        """SELECT coalesce(regexp_matches(trim(text), '(?i)^`*\\s*NO[_ ]?CHANGES\\s*`*$') OR (NOT contains(text, '[') AND regexp_matches(text, '(?is)```[^\\n]*\\n\\s*`*\\s*NO[_ ]?CHANGES\\s*`*\\s*```')), false) AS no_changes, count(*) AS n
FROM (SELECT DISTINCT completion_id, text FROM completions WHERE stage = 'proofread') GROUP BY 1""",
    ),
    "delta_replies": (
        lambda s, r: proofread(s, r).filter("text is not null").groupBy(X.is_delta(F.col("text")).alias("delta")).agg(F.count(F.lit(1)).alias("n")),
        r"""SELECT upper(replace(replace(b, '_', ''), ' ', '')) = 'NOCHANGES' OR starts_with(b, '[') OR NOT regexp_matches(b, '(?m)^===PARAGRAPH\s+\d+===\s*$') AS delta, count(*) AS n
FROM (SELECT DISTINCT completion_id, trim(regexp_replace(regexp_replace(trim(text, ' ' || chr(10)), '^```[^\n]*(\n|$)', ''), '(^|\n)```[^\n]*$', ''), ' ' || chr(10)) AS b FROM completions WHERE stage = 'proofread' AND text IS NOT NULL) GROUP BY 1""",
    ),
    "read_replies": (lambda s, r: patches.read_replies(proofread(s, r), "completion_id", "text").select("completion_id", "outcome", F.size("patches").alias("n")), w(OUTCOME, "SELECT completion_id, outcome, CAST(len(objs) AS INT) AS n FROM outc")),
    "apply_patches": (lambda s, r: _patched(s, r).select("completion_id", "at", "p", "verdict"), w(PATCHED, 'SELECT completion_id, CAST(pos AS INT) AS "at", p, verdict FROM ver3')),
    "patched_texts": (
        lambda s, r: _patched(s, r, patches.patched).select("completion_id", "outcome", "changed", F.md5("text").alias("digest")),
        w(PATCHED + r""",
new AS (SELECT giv.completion_id, list_transform(ps, lambda x, i: coalesce((m.m)[i], x)) AS now, ps FROM giv LEFT JOIN (SELECT completion_id, map_from_entries(list((p, after))) AS m FROM ver3 WHERE verdict = 'applied' GROUP BY completion_id) m USING (completion_id)),
fin AS (SELECT giv.completion_id, CASE WHEN giv.completion_id IN (SELECT completion_id FROM ver3 WHERE verdict = 'out_of_range') THEN 'out_of_range' ELSE outcome END AS outcome, now, n.ps FROM giv JOIN new n ON n.completion_id = giv.completion_id AND len(n.ps) > 0)""",
          r"""SELECT completion_id, outcome, CASE WHEN outcome IN ('patches', 'no_changes') THEN now <> ps END AS changed,
  CASE WHEN outcome IN ('patches', 'no_changes') THEN md5(list_aggregate(list_transform(now, lambda x, i: '===PARAGRAPH ' || i || '===' || chr(10) || x), 'string_agg', chr(10))) END AS digest FROM fin"""),
    ),
    "rejected_replies": (
        lambda s, r: patches.read_replies(proofread(s, r), "completion_id", "text").filter("outcome = 'rejected'").join(proofread(s, r), "completion_id").select("completion_id", "text"),
        w(OUTCOME, "SELECT completion_id, text FROM outc WHERE outcome = 'rejected'"),
    ),
    "malformed_fragments": (
        lambda s, r: first_malformed(_texts(s, r).select("seq", X.split_markers(F.col("content")).alias("ps")).filter("ps is not null"), "ps", "number").filter("number > 0").select("seq", "number"),
        w(f"{REV}, {NEWEST}, parts AS (SELECT seq, regexp_split_to_array(regexp_replace(regexp_replace(trim(content, ' ' || chr(10)), '^```[^\\n]*\\n', ''), '\\n```[^\\n]*$', ''), '(?m)^===PARAGRAPH\\s+\\d+===\\s*$') AS parts FROM stg), bad AS (SELECT seq, list_position(list_transform(parts[2:], lambda x: {PARSES.format(x='x')}), false) AS number FROM parts WHERE len(parts) > 1)",
          "SELECT seq, CAST(number AS INT) AS number FROM bad WHERE number > 0"),
    ),
    "cached_replies": (
        lambda s, r: _cached(s, r).groupBy("stage", "outcome").agg(F.count(F.lit(1)).alias("n")),
        w(f"""{REV}, {EXPECTED}, stg AS (SELECT DISTINCT ON (key) * FROM rev WHERE key IS NOT NULL AND stage IN ('translate', 'reflect') ORDER BY key), {VALID},
asked AS (SELECT DISTINCT completion_id, key, stage FROM completions WHERE key IS NOT NULL AND stage IN ('translate', 'reflect'))""",
          "SELECT asked.stage, CASE WHEN asked.key IN (SELECT key FROM fine WHERE len(parts) > 1) THEN 'cached' ELSE 'cached_broken' END AS outcome, count(*) AS n FROM asked JOIN val USING (key) GROUP BY ALL"),
    ),
    "retry_budget": (
        lambda s, r: table(s, r, "completions", "completion_id", "stage").distinct().groupBy("stage").agg(F.count(F.lit(1)).alias("n")).select("stage", X.retry_budget(F.col("n")).alias("budget")),
        "SELECT stage, CAST(greatest(3, count(*) // 10) AS INT) AS budget FROM (SELECT DISTINCT completion_id, stage FROM completions) GROUP BY stage",
    ),
    "parsed_verdicts": (
        lambda s, r: parse_replies(table(s, r, "completions").filter("stage = 'judge'").select("completion_id", "text").distinct(), "completion_id", "text"),
        r"""WITH rep AS (SELECT DISTINCT completion_id, regexp_replace(regexp_replace(trim(text), '^```[^\n]*\n', ''), '\n```[^\n]*$', '') AS body FROM completions WHERE stage = 'judge'),
got AS (SELECT completion_id, coalesce(json_valid(body), false) AS fine, CASE WHEN coalesce(json_valid(body), false) THEN body END AS body FROM rep)
SELECT completion_id, fine AND coalesce(try_cast(json_extract_string(body, '$.score') AS INT) BETWEEN 1 AND 5, false) AS ok, try_cast(json_extract_string(body, '$.score') AS INT) AS score,
  CASE WHEN fine AND try_cast(json_extract_string(body, '$.score') AS INT) IS NOT NULL THEN CAST(CASE WHEN json_type(body, '$.issues') = 'VARCHAR' THEN 1 ELSE coalesce(json_array_length(body, '$.issues'), 0) END AS INT) END AS n_issues FROM got""",
    ),
    "borrowed_sentence": (
        _borrowed,
        r"""WITH rep AS (SELECT DISTINCT completion_id, user_prompt, text FROM completions WHERE stage IN ('translate', 'reflect') AND text IS NOT NULL),
parts AS (SELECT completion_id, regexp_split_to_array(regexp_replace(regexp_replace(trim(text, ' ' || chr(10)), '^```[^\n]*\n', ''), '\n```[^\n]*$', ''), '(?m)^===PARAGRAPH\s+\d+===\s*$')[2:] AS a, regexp_split_to_array(user_prompt, '(?m)^===PARAGRAPH\s+\d+===\s*$')[2:] AS b FROM rep),
mine AS (SELECT completion_id, unnest(range(len(a))) + 1 AS p, trim(regexp_replace(regexp_replace(unnest(a), '<[^>]+>', ' ', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g')) AS t FROM parts),
theirs AS (SELECT completion_id, unnest(range(len(b))) + 1 AS other, trim(regexp_replace(regexp_replace(unnest(b), '<[^>]+>', ' ', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g')) AS t FROM parts),
sent AS (SELECT completion_id, other, unnest(string_split(regexp_replace(t, '([.!?…»]) ', '\1' || chr(31), 'g'), chr(31))) AS s FROM theirs)
SELECT DISTINCT completion_id, CAST(p AS INT) AS p, CAST(other AS INT) AS other FROM mine JOIN sent USING (completion_id) WHERE other <> p AND length(s) >= 40 AND contains(mine.t, s)
  AND NOT EXISTS (SELECT 1 FROM theirs o WHERE o.completion_id = mine.completion_id AND o.other = mine.p AND contains(o.t, sent.s))""",
    ),
    "parse_issue": (
        lambda s, r: V.verdicts(rev(s, r)).select("seq", F.explode("issues").alias("raw")).select("seq", "raw", repair.parse_issue(F.col("raw")).alias("i")).select("seq", "raw", "i.category", "i.paragraph", "i.old", "i.new"),
        w(f"{REV}, {JUDGE}, {ISSUE}", "SELECT seq, raw, category, paragraph, old, new FROM cut"),
    ),
    "classify_issue": (
        lambda s, r: proposals(s, r).select("book_id", "chunk_id", "n", "skip", "deferred"),
        w(f"{REV}, {NEWEST}, {JUDGE}, {NOW}, {ISSUE}, {EXPECTED}, {VALID}, {PROPOSE}", "SELECT book_id, chunk_id, CAST(n AS INT) AS n, skip, skip IS NOT NULL AND skip NOT IN ('quote_absent', 'out_of_scope', 'no_category', 'no_op') AS deferred FROM prop"),
    ),
    "propose": (
        lambda s, r: proposals(s, r).filter("skip is null").groupBy("issue.category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("book_id", "chunk_id").alias("n_chunks")),
        w(f"{REV}, {NEWEST}, {JUDGE}, {NOW}, {ISSUE}, {EXPECTED}, {VALID}, {PROPOSE}", "SELECT category, count(*) AS n, count(DISTINCT (book_id, chunk_id)) AS n_chunks FROM prop WHERE skip IS NULL GROUP BY category"),
    ),
    "unhandled_issues": (
        lambda s, r: proposals(s, r).filter("deferred").groupBy("book_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "skip", "raw"))), "\n").alias("report")),
        w(f"{REV}, {NEWEST}, {JUDGE}, {NOW}, {ISSUE}, {EXPECTED}, {VALID}, {PROPOSE}", "SELECT book_id, chunk_id, string_agg(skip || ': ' || raw, chr(10) ORDER BY skip || ': ' || raw) AS report FROM prop WHERE skip NOT IN ('quote_absent', 'out_of_scope', 'no_category', 'no_op') GROUP BY ALL"),
    ),
    "vetted_candidates": (
        lambda s, r: _vetted(s, r).select("book_id", "chunk_id", "place", "accepted"),
        w(f"RECURSIVE {REV}, {NEWEST}, {JUDGE}, {NOW}, {ISSUE}, {EXPECTED}, {VALID}, {PROPOSE}, {FOLD}", "SELECT book_id, chunk_id, CAST(place AS INT) AS place, place % 3 = 1 AS accepted FROM cand"),
    ),
    "apply_candidates": (
        lambda s, r: repair.apply(_vetted(s, r), valid_texts(s, r)).select("book_id", "chunk_id", "n_applied", F.md5(F.concat_ws("\n", "paragraphs")).alias("digest")),
        w(f"RECURSIVE {REV}, {NEWEST}, {JUDGE}, {NOW}, {ISSUE}, {EXPECTED}, {VALID}, {PROPOSE}, {FOLD}", "SELECT book_id, chunk_id, n_applied, md5(array_to_string(ps, chr(10))) AS digest FROM done"),
    ),
    "repair_stage": (
        lambda s, r: _repaired(s, r).select("book_id", "chunk_id", "stage", "accepted", F.md5("content").alias("digest")),
        w(f"RECURSIVE {REV}, {NEWEST}, {JUDGE}, {NOW}, {ISSUE}, {EXPECTED}, {VALID}, {PROPOSE}, {FOLD}", """SELECT book_id, chunk_id, 'repair_verdicts' AS stage, CAST(count(*) FILTER (place % 3 = 1) AS INT) AS accepted,
  md5('[' || string_agg('{"n": ' || place || ', "verdict": "' || CASE WHEN place % 3 = 1 THEN 'accept' ELSE 'reject' END || '"}', ', ' ORDER BY place) FILTER (place % 3 > 0) || ']') AS digest FROM cand GROUP BY book_id, chunk_id
UNION ALL SELECT book_id, chunk_id, 'repair', (SELECT CAST(count(*) AS INT) FROM acc a WHERE a.book_id = done.book_id AND a.chunk_id = done.chunk_id), md5(list_aggregate(list_transform(ps, lambda x, i: '===PARAGRAPH ' || i || '===' || chr(10) || x), 'string_agg', chr(10))) FROM done"""),
    ),
    "repair_legacy": (
        _legacy,
        w(f"{REV}, {NEWEST}, {JUDGE}, {NOW}, {ISSUE}, {EXPECTED}, {VALID}, {PROPOSE}, num AS (SELECT book_id, chunk_id, count(*) AS k FROM prop WHERE skip IS NULL GROUP BY ALL), old AS (SELECT val.*, k, len(parts) > 1 AND len(parts) - 1 = n_expected AS same, coalesce(CAST(json_extract_string(meta, '$.accepted') AS INT), 0) AS acc FROM val LEFT JOIN num USING (book_id, chunk_id) WHERE stage = 'repair' AND coalesce(json_extract_string(meta, '$.verdicts'), 'false') <> 'true')",
          "SELECT book_id, chunk_id, CASE WHEN same THEN 'used' ELSE 'broken' END AS outcome, CASE WHEN same THEN acc END AS accepted, CASE WHEN same THEN CAST(greatest(coalesce(k, 0) - acc, 0) AS INT) END AS rejected FROM old"),
    ),
    "glossary_replies": (
        lambda s, r: _glossary_replies(s, r).select("book_id", "outcome", "n_invalid", F.when(F.col("entries").isNotNull(), F.size("entries")).alias("n_entries"), F.when(F.col("entries").isNotNull(), F.size(F.filter("entries", lambda x: F.coalesce(x["notes"], F.lit("")).startswith(glossary.OVERRIDE)))).alias("n_override")),
        w(CAND + """, bok AS (SELECT book_id, count(*) FILTER (NOT fine) AS bad, count(*) FILTER (fine) AS good, count(*) FILTER (fine AND (cand_id % 3 = 0 OR starts_with(coalesce(notes, ''), '[override]'))) AS over
  FROM (SELECT *, original IS NOT NULL AND translation IS NOT NULL AND cand_id % 7 <> 0 AND type IN ('person','place','concept','term','other') AND gender IN ('m','f','n','unknown') AS fine FROM cand WHERE book_id IS NOT NULL) GROUP BY book_id),
out2 AS (SELECT *, CASE WHEN good = 0 THEN 'unreadable' WHEN book_id % 5 = 0 THEN 'cut_start' WHEN book_id % 4 = 0 THEN 'cut_end' ELSE 'read' END AS outcome FROM bok)""",
          "SELECT book_id, outcome, CASE WHEN outcome <> 'unreadable' THEN CAST(bad AS INT) END AS n_invalid, CASE WHEN outcome = 'read' THEN CAST(good AS INT) END AS n_entries, CASE WHEN outcome = 'read' THEN CAST(over AS INT) END AS n_override FROM out2"),
    ),
    "glossary_entries": (lambda s, r: candidates(s, r).groupBy("book_id", "type").agg(F.count(F.lit(1)).alias("n")), w(CAND, "SELECT book_id, type, count(*) AS n FROM cand GROUP BY ALL")),
    "glossary_summary": (
        lambda s, r: glossary.summary(candidates(s, r)),
        w(CAND, "SELECT coalesce(type, 'total') AS type, count(*) AS n, count(*) FILTER (starts_with(notes, '[override]')) AS n_override, CASE WHEN type IS NULL THEN 100 ELSE coalesce(list_position(['person', 'place', 'concept', 'term', 'other'], type) - 1, 99) END AS place FROM cand GROUP BY ROLLUP (type)"),
    ),
    "render_glossary": (
        lambda s, r: glossary.render(candidates(s, r), ["book_id"], table(s, r, "books", "book_id")),
        w(CAND, """SELECT books.book_id, coalesce(block, '(no known terms yet)') AS block FROM books LEFT JOIN (SELECT book_id, string_agg(original || ' | ' || translation || ' | ' || CASE WHEN type = 'person' THEN type || ', ' || gender ELSE type END ||
  CASE WHEN coalesce(notes, '') = '' THEN '' ELSE ' | ' || CASE WHEN length(s) > 120 THEN s[1:117] || '...' ELSE s END END, chr(10) ORDER BY cand_id) AS block
FROM (SELECT *, trim(regexp_replace(notes, '[\\s\\p{Z}\\x{85}]+', ' ', 'g')) AS s FROM cand) GROUP BY book_id) USING (book_id)"""),
    ),
    "top_n_per_type": (
        lambda s, r: glossary.top(candidates(s, r), 10),
        w(CAND, "SELECT type, CAST(row_number() OVER o AS INT) AS place, cand_id, original, greatest(count(*) OVER (PARTITION BY type) - 10, 0) AS n_more FROM cand WINDOW o AS (PARTITION BY type ORDER BY lower(original), cand_id) QUALIFY place <= 10"),
    ),
    "promote": (
        _promote,
        w(CAND + """,
every AS (SELECT cand.*, target_lang AS series FROM cand JOIN books USING (book_id)),
known AS (SELECT series, original, arg_max(translation, cand_id) AS known FROM every WHERE cand_id % 5 = 0 GROUP BY ALL),
rows AS (SELECT every.*, gender <> 'unknown' AS ok, known, row_number() OVER o AS n, first_value(translation) OVER o AS f
  FROM every LEFT JOIN known USING (series, original) WHERE cand_id % 5 <> 0 AND original IS NOT NULL WINDOW o AS (PARTITION BY series, original, gender <> 'unknown' ORDER BY cand_id)),
cmp AS (SELECT *, coalesce(known, CASE WHEN n > 1 THEN f END) AS against FROM rows)""",
          "SELECT cand_id, series, original, CASE WHEN NOT ok THEN 'unapproved' WHEN against IS NULL THEN 'added' WHEN against IS NOT DISTINCT FROM translation THEN 'existing' ELSE 'conflict' END AS outcome, CASE WHEN ok THEN against END AS series_translation FROM cmp"),
    ),
    "merged_series": (
        lambda s, r: _merged(s, r),
        w(CAND + """,
every AS (SELECT cand.*, target_lang AS series FROM cand JOIN books USING (book_id)),
known AS (SELECT series, original, arg_max((translation, type), cand_id) AS known FROM every WHERE cand_id % 5 = 0 GROUP BY ALL),
added AS (SELECT series, original, translation, type FROM every LEFT JOIN known USING (series, original) WHERE cand_id % 5 <> 0 AND original IS NOT NULL AND gender <> 'unknown' AND known IS NULL
  QUALIFY row_number() OVER (PARTITION BY series, original ORDER BY cand_id) = 1),
al AS (SELECT series, original, known[1] AS translation, known[2] AS type FROM known UNION ALL SELECT * FROM added)""",
          "SELECT series, original, translation, type, row_number() OVER (PARTITION BY series ORDER BY coalesce(list_position(['person', 'place', 'concept', 'term', 'other'], type) - 1, 99), lower(original), original) - 1 AS place FROM al"),
    ),
    "note_candidates_eligible": (
        lambda s, r: notes.eligible(candidates(s, r), ["person", "place", "term"]).select("cand_id", "book_id", "place"),
        w(CAND, "SELECT cand_id, book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY length(translation) DESC, cand_id) AS INT) AS place FROM cand WHERE type IN ('person','place','term') AND coalesce(notes, '') <> '' AND regexp_matches(translation, '[^\\s\\p{Z}\\x{85}]')"),
    ),
    "first_in_book": (lambda s, r: notes.placements(notes.eligible(candidates(s, r), ["person", "place", "term"]), _translated_paragraphs(s, r)), None),
    "first_in_chapter": (lambda s, r: notes.placements(notes.eligible(candidates(s, r), ["person", "place", "term"]), _translated_paragraphs(s, r), "first-in-chapter"), None),
    "every_paragraph": (lambda s, r: notes.placements(notes.eligible(candidates(s, r), ["person", "place", "term"]), _translated_paragraphs(s, r), "all"), None),
    "term_probe_join": (
        lambda s, r: notes.word_matches(candidates(s, r).select("cand_id", "book_id", F.lower("original").alias("probe")), paragraphs(s, r)),
        w(f"{CAND}, {PARA}, tok AS (SELECT DISTINCT book_id, chapter_idx, para_idx, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM para)",
          "SELECT DISTINCT cand_id, cand.book_id, chapter_idx, para_idx FROM cand JOIN tok ON tok.book_id = cand.book_id AND tok.word = lower(cand.original)"),
    ),
    "first_mention": (
        lambda s, r: notes.word_matches(candidates(s, r).select("cand_id", "book_id", F.lower("original").alias("probe")), paragraphs(s, r)).groupBy("cand_id").agg(F.min(F.struct("chapter_idx", "para_idx")).alias("f")).select("cand_id", "f.*"),
        w(f"{CAND}, {PARA}, tok AS (SELECT DISTINCT book_id, chapter_idx, para_idx, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM para)",
          "SELECT cand_id, chapter_idx, para_idx FROM cand JOIN tok ON tok.book_id = cand.book_id AND tok.word = lower(cand.original) QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY chapter_idx, para_idx) = 1"),
    ),
    "term_probe_contains": (lambda s, r: _probed(s, r), None),
    "first_probe_mention": (lambda s, r: _probed(s, r).groupBy("cand_id").agg(F.min(F.struct("chapter_idx", "para_idx")).alias("f")).select("cand_id", "f.*"), None),
    "key_hash": (
        lambda s, r: table(s, r, "completions", "completion_id", "stage", "model", "user_prompt").distinct().select("completion_id", X.content_key(F.col("stage"), F.col("model"), F.col("user_prompt")).alias("key")),
        "SELECT DISTINCT completion_id, sha256(coalesce(stage, '') || chr(31) || coalesce(model, '') || chr(31) || coalesce(user_prompt, '') || chr(31)) AS key FROM completions",
    ),
    "size_warning": (
        lambda s, r: table(s, r, "completions", "completion_id", "text", "reasoning").withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("reasoning"), F.lit(0))).filter(F.col("n") >= 0.85 * 2000).select("completion_id", "n").distinct(),
        "SELECT DISTINCT completion_id, CAST(coalesce(strlen(text), 0) + coalesce(strlen(reasoning), 0) AS INT) AS n FROM completions WHERE coalesce(strlen(text), 0) + coalesce(strlen(reasoning), 0) >= 0.85 * 2000",
    ),
    "lang_name": (
        lambda s, r: table(s, r, "documents", F.explode(F.array("lang", F.concat("lang", F.lit("_XX")), F.upper("lang"))).alias("lang")).unionByName(s.createDataFrame([(c,) for c in ["ar", "no-NO", "da", "en-GB", "bg", "zh-Hant-TW", ""]], "lang string")).distinct().select("lang", X.language_name(F.col("lang")).alias("name")),
        """WITH known AS (SELECT unnest(['ru','de','fr','es','it','pt','nl','pl','uk','zh','ja','ko','ar','tr','sv','no','da','fi','cs','hu']) AS code,
  unnest(['Russian','German','French','Spanish','Italian','Portuguese','Dutch','Polish','Ukrainian','Chinese','Japanese','Korean','Arabic','Turkish','Swedish','Norwegian','Danish','Finnish','Czech','Hungarian']) AS name),
tag AS (SELECT DISTINCT lang FROM (SELECT unnest([lang, lang || '_XX', upper(lang)]) AS lang FROM documents UNION ALL SELECT unnest(['ar', 'no-NO', 'da', 'en-GB', 'bg', 'zh-Hant-TW', ''])))
SELECT lang, name FROM tag LEFT JOIN known ON code = split_part(replace(lower(lang), '_', '-'), '-', 1)""",
    ),
    "path_normalize": (
        lambda s, r: table(s, r, "books", "book_id", F.regexp_replace("title", "[^A-Za-z]", "_").alias("t")).select("book_id", F.posexplode(F.array(*[F.replace(F.lit(p), F.lit("{}"), F.col("t")) for p in PATHS])).alias("shape", "raw")).select("book_id", "shape", X.normalize_path(F.col("raw")).alias("path")),
        """SELECT book_id, CAST(shape AS INT) AS shape, CASE shape WHEN 0 THEN 'OEBPS/images/' || t || '.xhtml' WHEN 1 THEN 'b.xhtml' WHEN 2 THEN t || '.png' ELSE 'a/' || t || '/d.html' END AS path
FROM (SELECT book_id, regexp_replace(title, '[^A-Za-z]', '_', 'g') AS t, unnest(range(4)) AS shape FROM books)""",
    ),
    "epub_meta": (
        lambda s, r: epub.read_meta(_archives(s, r)).select(book(), "title", "author", "language", "epub_version", "word_count", "n_chapters", "n_paragraphs", "problem"),
        w(HELD, """SELECT bok.book_id, coalesce(nullif(trim(title), ''), CAST(book_id AS VARCHAR)) AS title, coalesce(nullif(trim(author), ''), 'Unknown') AS author, coalesce(nullif(trim(book_lang), ''), 'en') AS language, coalesce(epub_version, '2.0') AS epub_version,
  CAST(sum(words) AS BIGINT) AS word_count, CAST(max(titles) AS INT) AS n_chapters, CAST(count(*) AS INT) AS n_paragraphs, CAST(NULL AS VARCHAR) AS problem
FROM bok JOIN red USING (book_id) JOIN (SELECT book_id, max(place) + 1 AS titles FROM pla GROUP BY book_id) USING (book_id) GROUP BY ALL"""),
    ),
    "epub_paragraphs": (
        lambda s, r: epub.read_paragraphs(_archives(s, r)).select(book(), "chapter_idx", "para_idx", "tag", F.md5("text").alias("digest"), "n_words"),
        w(HELD, "SELECT book_id, CAST(place AS INT) AS chapter_idx, CAST(n AS INT) AS para_idx, coalesce(tag, 'p') AS tag, md5(text) AS digest, CAST(words AS INT) AS n_words FROM red"),
    ),
    "epub_chapters": (
        lambda s, r: epub.read_chapters(_archives(s, r)).select(book(), "pos", "name", F.length(F.regexp_replace("text", r"(?U)\s+", "")).alias("n_chars")),
        w(HELD, "SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY place) - 1 AS INT) AS pos, format('OEBPS/text/{:05d}.xhtml', place) AS name, CAST(sum(length(regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', '', 'g'))) AS INT) AS n_chars FROM red GROUP BY book_id, place"),
    ),
    "epub_spine": (
        lambda s, r: epub.read_items(_archives(s, r)).select(book(), "item_id", "name", "spine_place").filter("spine_place is not null"),
        w(HELD, "SELECT DISTINCT book_id, 'c' || place AS item_id, format('OEBPS/text/{:05d}.xhtml', place) AS name, CAST(place AS INT) AS spine_place FROM pla"),
    ),
    "epub_rewritten": (
        lambda s, r: _rewritten(s, r).select(book(), "chapter_idx", "para_idx", F.md5("text").alias("digest")),
        w(HELD, "SELECT book_id, CAST(place AS INT) AS chapter_idx, CAST(n AS INT) AS para_idx, md5(lower(text)) AS digest FROM red"),
    ),
    "mime_sniff": (
        lambda s, r: table(s, r, "books", "book_id", F.explode(F.array(*map(F.lit, HEADS))).alias("head")).select("book_id", "head", X.image_type(F.unhex(F.concat("head", F.hex(F.col("book_id").cast("string"))))).alias("media_type")),
        "SELECT book_id, head, media_type FROM books, (VALUES " + ", ".join(f"('{h}', {repr(m) if m else 'NULL'})" for h, m in HEADS.items()) + ") AS t(head, media_type)",
    ),
    "slugs": (
        lambda s, r: slug(table(s, r, "books", "book_id", "title"), "title"),
        r"SELECT book_id, title, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\x00-\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'book') AS slug FROM books",
    ),
    "epub3_books": (lambda s, r: table(s, r, "books").groupBy(F.coalesce("epub_version", F.lit("2.0")).startswith("3").alias("epub3")).agg(F.count(F.lit(1)).alias("n")), "SELECT starts_with(coalesce(epub_version, '2.0'), '3') AS epub3, count(*) AS n FROM books GROUP BY 1"),
    "revision_diff": (lambda s, r: unified_diff(rev(s, r)), None),
}


def _translated_paragraphs(s, r):
    """The assembled text, paragraph by paragraph, without tags."""
    rows = W.assemble(table(s, r, "chunks"), rev(s, r))
    return durable(rows.select("book_id", "chapter_idx", "para_idx", X.plain_text(F.col("text")).alias("text")))


def _probed(s, r):
    """Every term with the translated paragraphs that contain its probe."""
    terms = candidates(s, r).filter(F.col("translation").rlike(r"(?U)\S")).withColumn("place", F.lit(None).cast("int"))
    return notes.probe_matches(terms, _translated_paragraphs(s, r))
