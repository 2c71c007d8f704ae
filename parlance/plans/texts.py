"""Queries on decoded text, rendered lines and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import chunks, search, summaries, transcripts
from parlance.plans import record
from parlance.sources import project as P

DECODED = ("concat(text, ' ', text)",)


def docs(spark, d):
    return P.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def turns(spark, d):
    return P.table(spark, d, "conversations").select("conv_id", "turn", "text")


def text_plain(spark, d):
    """both normal forms, as digests."""
    return docs(spark, d).select("doc_id", F.md5(T.plain(F.col("text"))).alias("plain"), F.md5(T.spaced(F.col("text"))).alias("spaced"))


def text_judged(spark, d):
    """what silence yields, and what says nothing."""
    short = F.concat(F.element_at(F.array(F.lit("Thank you."), F.lit("..."), F.lit("[BLANK_AUDIO]"), F.lit("aaaa bbbb aaaa"), F.lit("好"), F.lit("Yes")), (F.col("doc_id") % 6 + 1).cast("int")), F.when(F.col("doc_id") % 5 == 4, F.col("source")).otherwise(F.lit("")))
    return docs(spark, d).select("doc_id", T.invented(short).alias("invented"), T.meaningless(short).alias("meaningless"))


def repetition(spark, d):
    """share of repeated words."""
    return turns(spark, d).select("conv_id", "turn", F.round(T.repetition(F.coalesce("text", F.lit(""))), 6).alias("ratio"))


def text_clean(spark, d):
    """The decoded text to keep, collapsed; null if it is a loop, an invention or nothing."""
    return turns(spark, d).select("conv_id", "turn", T.cleaned(F.concat_ws(" ", F.col("text"), F.when(F.col("turn") % 3 == 0, F.col("text")))).alias("kept"))


def segments_kept(spark, d):
    """Decodes over the confidence floor, cleaned, in the order they were said."""
    confidence = (F.col("conv_id") * 7 + F.col("turn") * 3) % 20 / 20
    said = turns(spark, d).select(F.col("conv_id").alias("meeting"), F.when(F.col("turn") % 2 == 0, "mic").otherwise("system").alias("channel"), (F.col("turn") * 1000).cast("long").alias("start_ms"), (F.col("turn") * 1000 + 900).cast("long").alias("end_ms"), "text", confidence.alias("confidence"))
    return transcripts.kept_decodes(said)


def collapse_phrases(spark, d):
    """phrases in a row become one."""
    tail = F.array_join(F.slice(T.words(T.squeeze(F.col("text"))), 1, 4), " ")
    return turns(spark, d).select("conv_id", "turn", T.collapse_phrases(F.concat_ws(" ", tail, tail, F.col("text"))).alias("kept"))


def slug(spark, d):
    """file-name slugs of the texts."""
    return docs(spark, d).select("doc_id", T.slug(F.col("text")).alias("slug"))


def short_ids(spark, d):
    """both short forms of an id."""
    identifier = F.concat(F.lit("01AB-"), F.md5(F.col("doc_id").cast("string")))
    return docs(spark, d).select("doc_id", T.short_id(identifier).alias("head"), T.short_id(identifier, tail=True).alias("tail"))


def file_names(spark, d):
    """The file name of each meeting's document."""
    return P.meetings(spark, d).select("id", T.file_name(F.col("started_at"), F.col("title"), F.col("detected_app"), F.md5(F.col("id").cast("string"))).alias("name"))


def token_estimate(spark, d):
    """estimated tokens of each text."""
    return docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


def language_mix(spark, d):
    """characters and words by script, and the language that dominates."""
    mixed = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("会议纪要"), 800)).otherwise(F.lit("")), F.when(F.col("doc_id") % 6 == 0, F.repeat(F.lit("ありがとう"), 900)).otherwise(F.lit("")))
    return docs(spark, d).select("doc_id", *[n.alias(k) for k, n in T.script_counts(mixed).items()], T.dominant_language(mixed).alias("language"))


def control_markers(spark, d):
    """markers made harmless."""
    return docs(spark, d).select("doc_id", F.md5(T.escaped(F.concat(F.lit("<|im_start|>"), F.col("text"), F.lit("</transcript>[INST]")))).alias("escaped"))


def scrubbed(spark, d):
    """answers without thoughts and fences."""
    said = F.concat(F.lit("<think>"), F.col("source"), F.lit("</think>\n```md\n# "), F.col("lang"), F.lit(": "), F.col("source"), F.lit("\n```"), F.when(F.col("doc_id") % 2 == 0, F.lit("<think>open")).otherwise(F.lit("")))
    return docs(spark, d).select("doc_id", T.scrubbed(said).alias("answer"))


def titles(spark, d):
    """the title that a summary's heading gives, if it names the meeting."""
    head = F.element_at(F.array(F.lit("# Meeting Summary: Plan "), F.lit("# Summary"), F.lit("intro\n# Budget "), F.lit("no heading ")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", T.title_of(F.concat(head, F.when(F.col("doc_id") % 4 != 1, F.col("source")).otherwise(F.lit("")), F.lit("\nbody"))).alias("title"))


def spoken_lines(spark, d):
    """rendered lines read back."""
    return record.rendered_lines(spark, d).select("meeting", "sequence", T.spoken(F.col("line")).alias("s")).select("meeting", "sequence", "s.said_at", "s.who")


def table_rows(spark, d):
    """cells of table rows."""
    row = F.concat(F.lit("| "), F.col("source"), F.lit(" | does "), F.col("lang"), F.lit(" | soon |"), F.when(F.col("doc_id") % 2 == 0, F.lit(" 00:10 |")).otherwise(F.lit("")))
    return docs(spark, d).select("doc_id", F.array_join(T.table_cells(row), "/").alias("cells"))


def durations(spark, d):
    """lengths as text."""
    return P.table(spark, d, "orders").select("o_orderkey", T.duration(F.col("o_orderkey") * 7 % 9000).alias("length"))


def chunk_lines(spark, d):
    """transcripts cut to a token budget on line boundaries, with an overlap."""
    return chunks.chunked(record.rendered_lines(spark, d), single_pass=600).select("meeting", "chunk", "first", "last", "tokens")


def action_checks(spark, d):
    """of each segment's distinctive words, how many its speaker says anywhere in the meeting."""
    rows = record.labelled(spark, d).select("meeting", "sequence", "label", F.explode(F.array_distinct(T.distinctive(F.coalesce("text", F.lit(""))))).alias("word"))
    claims = rows.select(F.col("meeting"), F.col("sequence"), F.concat(F.lit("Speaker "), (F.col("sequence") % 3 + 1).cast("string")).alias("label"), "word")
    said = rows.select("meeting", "label", "word").distinct().withColumn("said", F.lit(1))
    return claims.join(said, ["meeting", "label", "word"], "left").groupBy("meeting", "sequence").agg(F.count(F.lit(1)).alias("words"), F.count("said").alias("said")).withColumn("borne_out", F.col("said") * 2 >= F.col("words"))


def made_summaries(spark, d):
    """Summaries of each meeting: its lines as table rows, under their own speaker, the next one's or nobody's name."""
    rows = record.labelled(spark, d).select("meeting", "sequence", "label", F.coalesce("text", F.lit("")).alias("text"))
    who = F.when(F.col("sequence") % 4 == 1, "Participant").when(F.col("sequence") % 4 == 2, "Nobody").otherwise(F.col("label"))
    what = T.spaced(F.col("text"))
    lines = rows.select("meeting", "sequence", F.concat(F.lit("| "), who, F.lit(" | "), what, F.lit(" | | |")).alias("line"))
    return lines.groupBy("meeting").agg(F.concat(F.lit("# Plan\n| Who | What | When | Said at |\n| --- | --- | --- | --- |\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "line"))), lambda x: x["line"]), "\n")).alias("summary"))


def spoken_parts(spark, d):
    return record.labelled(spark, d).select("meeting", "sequence", F.col("label").alias("speaker"), "text")


def summary_checks(spark, d):
    """which rows of a summary its people bear out."""
    return summaries.checked(made_summaries(spark, d), spoken_parts(spark, d)).select("meeting", "line", "who", "verdict")


def placeholder_rows(spark, d):
    """summaries without rows that credit nobody in particular."""
    return summaries.without_placeholders(made_summaries(spark, d))


def quoted_summaries(spark, d):
    """summaries all of whose words come from one line."""
    own = F.concat(F.lit("word"), F.md5(F.concat_ws("-", "meeting", "sequence")))
    lines = spoken_parts(spark, d).withColumn("text", F.concat_ws(" ", "text", own))
    copied = lines.where("sequence = meeting % 3 and meeting % 4 <> 0").select("meeting", F.element_at(F.split("text", " "), -1).alias("summary"))
    return summaries.quoted(copied, lines)


def search_index(spark, d):
    return search.postings(docs(spark, d).withColumnRenamed("doc_id", "id"), "id", "source", "text")


def postings(spark, d):
    """How many words each document has in the index, and how many kinds."""
    return search_index(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("term").alias("kinds"))


QUERY = "the of-the and"


def search_hits(spark, d):
    """The 25 best documents for words and a phrase."""
    return search.search(search_index(spark, d), QUERY)


def search_snippets(spark, d):
    """T4: of each hit, the window with the most words of the query, as written."""
    return search.snippets(docs(spark, d).withColumnRenamed("doc_id", "id"), search_hits(spark, d), QUERY)


A = r"\p{L}\p{M}\p{N}"
PLAIN = r"trim(regexp_replace(lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}\s]', '', 'g')), '\s+', ' ', 'g'))"
SPACED = r"trim(lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
S = P.sql
INDEX = f"""words AS (SELECT doc_id AS id, 0 AS field, unnest(string_split(s, ' ')) AS term, generate_subscripts(string_split(s, ' '), 1) AS position FROM (SELECT doc_id, {SPACED.format(t="source")} AS s FROM documents) WHERE s <> ''
  UNION ALL SELECT doc_id, 1, unnest(string_split(s, ' ')), generate_subscripts(string_split(s, ' '), 1) FROM (SELECT doc_id, {SPACED.format(t="coalesce(text, '')")} AS s FROM documents) WHERE s <> '')"""
P.SQL["words"] = INDEX
P.SQL["found"] = """hit AS (SELECT id, 0 AS phrase, count(*) AS tf FROM words WHERE term = 'the' GROUP BY id UNION ALL SELECT a.id, 1, count(*) FROM words a JOIN words b ON a.id = b.id AND a.field = b.field AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.id
  UNION ALL SELECT id, 2, count(*) FROM words WHERE term = 'and' GROUP BY id),
sizes AS (SELECT id, count(*) AS size FROM words GROUP BY id), whole AS (SELECT count(*) AS docs, avg(size) AS mean FROM sizes), rare AS (SELECT phrase, count(*) AS df FROM hit GROUP BY phrase),
found AS (SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score, CAST(sum(tf) AS BIGINT) AS hits FROM hit JOIN rare USING (phrase) JOIN sizes USING (id), whole GROUP BY id HAVING count(*) = 3 ORDER BY score DESC, id LIMIT 25)"""

P.SQL["asked"] = "asked AS (SELECT id, position FROM words WHERE field = 1 AND term IN ('the', 'of', 'and') AND id IN (SELECT id FROM found))"

QUERIES = {
    "text_plain": (text_plain, f"SELECT doc_id, md5({PLAIN.format(t='text')}) AS plain, md5({SPACED.format(t='text')}) AS spaced FROM documents"),
    "text_judged": (text_judged, f"""SELECT doc_id, {PLAIN.format(t='s')} IN ('thank you', 'blankaudio', 'you', 'okay') AS invented,
  NOT regexp_matches(s, '[\\p{{L}}\\p{{N}}]') OR (length(trim(s)) > 10 AND len(list_distinct(string_split(regexp_replace(s, '\\s', '', 'g'), ''))) <= 3) AS meaningless
  FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Thank you.' WHEN 1 THEN '...' WHEN 2 THEN '[BLANK_AUDIO]' WHEN 3 THEN 'aaaa bbbb aaaa' WHEN 4 THEN '好' ELSE 'Yes' END || CASE WHEN doc_id % 5 = 4 THEN source ELSE '' END AS s FROM documents)"""),
    "repetition": (repetition, f"SELECT conv_id, turn, CASE WHEN len(w) < 2 THEN 0.0::DOUBLE ELSE round(1.0 - len(list_distinct(w))::DOUBLE / len(w), 6) END AS ratio FROM (SELECT conv_id, turn, string_split({PLAIN.format(t='text')}, ' ') AS w FROM conversations)"),
    "text_clean": (text_clean, None),
    "segments_kept": (segments_kept, None),
    "collapse_phrases": (collapse_phrases, None),
    "slug": (slug, r"SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-+', ''), 1, 60), '^-+|-+$', '', 'g') AS slug FROM documents"),
    "short_ids": (short_ids, "SELECT doc_id, substr('01ab' || md5(CAST(doc_id AS VARCHAR)), 1, 12) AS head, right(md5(CAST(doc_id AS VARCHAR)), 12) AS tail FROM documents"),
    "file_names": (file_names, S("""SELECT id, substr(started_at, 1, 10) || '-' || regexp_replace(regexp_replace(lower(coalesce(nullif(trim(title), ''), detected_app, 'meeting')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || right(md5(CAST(id AS VARCHAR)), 12) || '.md' AS name FROM meetings""", "meetings")),
    "token_estimate": (token_estimate, "SELECT doc_id, CAST(trunc(CAST(length(text) AS FLOAT) * CAST(0.35 AS FLOAT)) AS BIGINT) AS tokens FROM documents"),
    "language_mix": (language_mix, r"""SELECT *, CASE WHEN han + kana + hangul <= latin_words THEN NULL WHEN hangul > han + kana THEN 'Korean' WHEN kana * 10 > han + kana THEN 'Japanese' ELSE 'Chinese' END AS language FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3200 ELSE 0 END::BIGINT AS han, CASE WHEN doc_id % 6 = 0 THEN 4500 ELSE 0 END::BIGINT AS kana, 0::BIGINT AS hangul, len(regexp_extract_all(text, '\p{L}+'))::BIGINT AS latin_words FROM documents)"""),
    "control_markers": (control_markers, "SELECT doc_id, md5('<' || chr(8203) || '|im_start|>' || text || '<' || chr(8203) || '/transcript>[' || chr(8203) || 'INST]') AS escaped FROM documents"),
    "scrubbed": (scrubbed, "SELECT doc_id, '# ' || lang || ': ' || source AS answer FROM documents"),
    "titles": (titles, "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Plan ' || source WHEN 2 THEN 'Budget ' || source END AS title FROM documents"),
    "spoken_lines": (spoken_lines, S("""SELECT meeting, sequence, CASE WHEN t >= 3600 THEN (t // 3600) || ':' ELSE '' END || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS said_at,
  coalesce(display_name, CASE WHEN channel = 'mic' THEN 'You' ELSE 'Participant' END) AS who FROM (SELECT *, start_ms // 1000 AS t FROM labelled)""", *record.RECORD)),
    "table_rows": (table_rows, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '/does ' || lang || '/soon/00:10' END AS cells FROM documents"),
    "durations": (durations, "SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS length FROM (SELECT o_orderkey, o_orderkey * 7 % 9000 AS s FROM orders)"),
    "chunk_lines": (chunk_lines, None),
    "action_checks": (action_checks, S(f"""SELECT c.meeting, c.sequence, count(*) AS words, count(w.word) AS said, count(w.word) * 2 >= count(*) AS borne_out FROM
  (SELECT DISTINCT meeting, sequence, 'Speaker ' || (sequence % 3 + 1) AS label, word FROM (SELECT meeting, sequence, unnest(string_split({SPACED.format(t="coalesce(text, '')")}, ' ')) AS word FROM labelled) WHERE length(word) >= 4) c
  LEFT JOIN (SELECT DISTINCT meeting, label, word FROM (SELECT meeting, label, unnest(string_split({SPACED.format(t="coalesce(text, '')")}, ' ')) AS word FROM labelled) WHERE length(word) >= 4) w USING (meeting, label, word) GROUP BY 1, 2""", *record.RECORD)),
    "postings": (postings, S("SELECT id, count(*) AS words, count(DISTINCT term) AS kinds FROM words GROUP BY id", "words")),
    "search_hits": (search_hits, S("SELECT id, score, hits FROM found", "words", "found")),
    "search_snippets": (search_snippets, S(r"""SELECT id, CASE WHEN start > 1 THEN '…' ELSE '' END || trim(array_to_string(pieces[start:start + 15], '')) || CASE WHEN len(pieces) > start + 15 THEN '…' ELSE '' END AS snippet FROM (
  SELECT id, regexp_extract_all(text, '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS pieces FROM found JOIN documents ON doc_id = id) JOIN (
  SELECT id, min_by(position, (-n, position)) AS start FROM (SELECT a.id, a.position, count(*) AS n FROM asked a JOIN asked b ON a.id = b.id AND b.position BETWEEN a.position AND a.position + 15 GROUP BY 1, 2) GROUP BY id) USING (id)""", "words", "found", "asked")),
    "summary_checks": (summary_checks, None),
    "placeholder_rows": (placeholder_rows, None),
    "quoted_summaries": (quoted_summaries, None),
}
