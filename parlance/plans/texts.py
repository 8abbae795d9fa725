"""Queries over documents and prompts: exports, protocol blocks, marks, action results, model inputs and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import learned, office
from parlance.operators import analytics, chunks, jobs, models, mutate, render, speakers, vocabulary
from parlance.plans.catalogue import CHUNK_SQL, NAME_SQL, SHORT_SQL
from parlance.plans.registry import query, told_apart
from parlance.sources import views as V


@query("""SELECT m.meeting_id, to_json(struct_pack(meeting := struct_pack(title := m.title, duration := m.duration), segments := (SELECT list(struct_pack(start := start_time, "end" := end_time, speaker := coalesce(p.display_name, p.label, 'Unknown'), text := s.text) ORDER BY s.ord)
  FROM seg s LEFT JOIN spk p USING (meeting_id, speaker_id) WHERE s.meeting_id = m.meeting_id)))::VARCHAR AS content FROM mtg m""")
def export_json(spark, sf):
    return render.json_document(V.meetings(spark, sf), V.segments(spark, sf), V.speakers(spark, sf))


PROTOCOL = "# **Protocol**\n\n§ 1 Opening\nOpened **on time**\nby *all*.\n---\n- DECISION: go\n1. one\nACTION: write\nplain\nACTION: joined\n#tag\nmore\n\n"
PROTOCOL_SQL = f""", t AS (SELECT s.meeting_id, '{PROTOCOL}' || string_agg('[' || coalesce(p.display_name, p.label, 'Unknown') || ']: ' || text, chr(10) ORDER BY ord) AS md FROM seg s LEFT JOIN spk p USING (meeting_id, speaker_id) GROUP BY 1),
l AS (SELECT meeting_id, i - 1 AS pos, trim(p[i]) AS line FROM (SELECT meeting_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT meeting_id, string_split(md, chr(10)) AS p FROM t))),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_full_match(line, '-{{3,}}|\\*{{3,}}|_{{3,}}') THEN 'rule' WHEN regexp_full_match(line, '#{{1,4}}\\s+.*') THEN 'heading' WHEN regexp_full_match(line, '§\\s*\\d+.*') THEN 'section' WHEN regexp_full_match(line, '[-*]\\s+.*') THEN 'bullet'
  WHEN regexp_full_match(line, '\\d+\\.\\s+.*') THEN 'number' WHEN contains(line, 'DECISION:') THEN 'decision' WHEN contains(line, 'ACTION:') THEN 'action' ELSE 'paragraph' END AS kind,
  line = '' OR line LIKE '#%' OR line LIKE '- %' OR line LIKE '* %' OR regexp_matches(line, '^\\d+\\.\\s|^§\\s*\\d+') OR regexp_full_match(line, '-{{3,}}|\\*{{3,}}|_{{3,}}') AS breaks FROM l),
i AS (SELECT *, sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY pos) AS island FROM k),
f AS (SELECT *, min(CASE WHEN kind = 'paragraph' THEN pos END) OVER (PARTITION BY meeting_id, island) AS plain FROM i),
g AS (SELECT meeting_id, CASE WHEN pos >= plain THEN plain ELSE pos END AS start, arg_min(kind, pos) AS kind, string_agg(line, ' ' ORDER BY pos) AS line FROM f WHERE kind <> 'blank' GROUP BY 1, 2),
b AS (SELECT *, CASE kind WHEN 'heading' THEN trim(trim(regexp_extract(line, '^#{{1,4}}\\s+(.*)$', 1), '*')) WHEN 'rule' THEN '' WHEN 'bullet' THEN regexp_extract(line, '^[-*]\\s+(.*)$', 1) WHEN 'number' THEN regexp_extract(line, '^\\d+\\.\\s+(.*)$', 1) ELSE line END AS text FROM g)
SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start) - 1 AS block, CASE WHEN kind = 'section' THEN 'heading' WHEN kind IN ('decision', 'action') THEN 'paragraph' ELSE kind END AS kind, CASE kind WHEN 'heading' THEN length(regexp_extract(line, '^(#{{1,4}})', 1)) WHEN 'section' THEN 2 ELSE 0 END AS level,
  CASE WHEN kind IN ('decision', 'action') THEN kind WHEN kind = 'bullet' AND contains(text, 'DECISION:') THEN 'decision' WHEN kind = 'bullet' AND contains(text, 'ACTION:') THEN 'action' END AS mark, text FROM b"""


@query(PROTOCOL_SQL)
def protocol_blocks(spark, sf):
    t = analytics.transcript_text(V.segments(spark, sf), V.speakers(spark, sf), "action", 10**9)
    rows = learned.block_rows(t.withColumn("md", F.concat(F.lit(PROTOCOL), "transcript")), "md", "meeting_id")
    return rows.select("meeting_id", F.col("block").cast("long").alias("block"), "kind", "level", "mark", "text")


@query(r"""WITH l AS (SELECT doc_id, n, 'a ' || regexp_replace(translate(s[n], '*', '+'), '(\w+) (\w+) (\w+)', '**\1** *\2* ***\3***', 'g') AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
x AS (SELECT doc_id, n, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, n, regexp_extract_all(t, '\*\*\*.*?\*\*\*|\*\*.*?\*\*|\*.*?\*|[^*]+') AS x FROM l))
SELECT doc_id, CAST(n - 1 AS INTEGER) AS line, CAST(i - 1 AS INTEGER) AS run, trim(x[i], '*') AS text, x[i] LIKE '**%' AS bold, (x[i] LIKE '*%' AND x[i] NOT LIKE '**%') OR x[i] LIKE '***%' AS italic FROM x""", views=False)
def inline_marks(spark, sf):
    """Marked runs of every line of every document; a document's own stars become plus signs first."""
    d = V.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    t = F.concat(F.lit("a "), F.regexp_replace(F.translate("s", "*", "+"), r"(\w+) (\w+) (\w+)", "**$1** *$2* ***$3***"))
    return d.select("doc_id", "line", F.posexplode(learned.inline_runs(t)).alias("run", "r")).select("doc_id", "line", "run", "r.*")


@query("SELECT doc_id AS result_id, i - 1 AS block, CASE WHEN regexp_matches(l, '^#{1,3} ') THEN length(regexp_extract(l, '^(#{1,3}) ', 1)) ELSE 0 END AS level, CASE WHEN regexp_matches(l, '^#{1,3} ') THEN regexp_replace(l, '^#{1,3} ', '') ELSE l END AS text FROM (SELECT doc_id, i, CASE i % 3 WHEN 0 THEN repeat('#', CAST(1 + i % 4 AS INTEGER)) || ' ' ELSE '' END || s[i] AS l FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)))", views=False)
def action_blocks(spark, sf):
    d = V.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("result_id"), F.split("text", "\n").alias("s"))
    head = lambda x, i: F.concat(F.when((i + 1) % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + (i + 1) % 4).cast("int")), F.lit(" "))).otherwise(""), x)
    rows = render.action_blocks(d.select("result_id", F.array_join(F.transform("s", head), "\n").alias("result_text")))
    return rows.select("result_id", F.col("block").cast("long").alias("block"), "level", "text")


@query("""SELECT meeting_id, '# Summary' || chr(10) || chr(10) || '**Meeting:** ' || title || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Result ' || meeting_id AS content FROM mtg WHERE meeting_id % 3 <> 0""")
def action_documents(spark, sf):
    m = V.meetings(spark, sf).withColumns({"action_name": F.lit("Summary"), "result_text": F.when(F.col("meeting_id") % 3 != 0, F.concat(F.lit("Result "), "meeting_id"))})
    return render.action_document(m).select("meeting_id", "content")


@query("SELECT meeting_id, n, 'signature' AS kind, repeat('_', 30) || chr(10) || r AS text FROM mtg, (VALUES (0, 'Chairperson'), (1, 'Reviewer')) v(n, r)")
def signature_lines(spark, sf):
    return render.signed(V.meetings(spark, sf))


@query(r"""WITH s AS (SELECT p_partkey AS k, '. ' || p_name || ' /' || p_type || '?. ' AS n FROM part) SELECT k, regexp_replace(n, '["\\/:<>|?*\x00-\x1f]', '_', 'g') AS name FROM s""", views=False)
def protocol_names(spark, sf):
    n = V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit(". "), "p_name", F.lit(" /"), "p_type", F.lit("?. ")).alias("n"))
    return n.select("k", render.protocol_filename("n").alias("name"))


@query("""SELECT 'meeting:' || o_custkey AS key, to_json(struct_pack("type" := 'progress', progress := CAST(o_orderkey % 101 AS DOUBLE), step := 'Step ' || o_orderkey % 5))::VARCHAR AS value FROM orders""", views=False)
def progress_events(spark, sf):
    o = V.table(spark, sf, "orders")
    return render.events(o.select(F.col("o_custkey").alias("meeting_id"), F.lit("progress").alias("type"), (F.col("o_orderkey") % 101).cast("double").alias("progress"), F.concat(F.lit("Step "), F.col("o_orderkey") % 5).alias("step")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 < 10 THEN 'audio' WHEN o_orderkey % 101 < 30 THEN 'whisper' WHEN o_orderkey % 101 < 45 THEN 'llm' WHEN o_orderkey % 101 < 75 THEN 'diarization' WHEN o_orderkey % 101 < 90 THEN 'alignment' WHEN o_orderkey % 101 < 100 THEN 'speaker_id' ELSE 'done' END AS step FROM orders", views=False)
def progress_steps(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 101).alias("p")).select("k", jobs.step_of("p").alias("step"))


#: A text as pages show it, but for spaces and line breaks: characters beyond Windows-1252 are question marks.
PDF_SQL = "regexp_replace(regexp_replace({t}, '[ \n]', '', 'g'), '[^\\x00-\\x7f\\x{{a0}}-\\x{{ff}}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g')"


def _file_texts(files, key):
    return files.select(key, F.md5(office.docx_paragraphs("docx")).alias("docx_text"), F.md5(F.regexp_replace(office.pdf_lines("pdf"), "[ \n]", "")).alias("pdf_text"))


@query(NAME_SQL + f""", d AS (SELECT *, CAST(floor(duration) AS BIGINT) AS i FROM mtg), e AS (
SELECT meeting_id, -2 AS ord, 0 AS k, title AS text FROM mtg UNION ALL SELECT meeting_id, -1, 0, 'Duration: ' || {SHORT_SQL.format(i='i')} FROM d UNION ALL SELECT meeting_id, ord, 0, name || ' [' || {SHORT_SQL.format(i='si')} || ']' FROM x WHERE turn UNION ALL SELECT meeting_id, ord, 1, text FROM x)
SELECT meeting_id, md5(string_agg(text, chr(10) ORDER BY ord, k)) AS docx_text, md5({PDF_SQL.format(t="string_agg(text, chr(10) ORDER BY ord, k)")}) AS pdf_text FROM e GROUP BY 1""")
def export_files(spark, sf):
    """Word-processor and page files of every recording: their texts as read back from the files."""
    blocks = render.document_blocks(V.meetings(spark, sf), V.segments(spark, sf), V.speakers(spark, sf))
    return _file_texts(office.document_files(blocks, "meeting_id"), "meeting_id")


@query(f"""WITH l AS (SELECT doc_id, i, CASE i % 3 WHEN 0 THEN repeat('#', CAST(1 + i % 4 AS INTEGER)) || ' ' ELSE '' END || s[i] AS l FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text <> ''))),
b AS (SELECT doc_id, -2 AS i, CASE WHEN doc_id % 5 = 0 THEN 'Action' ELSE 'Summary ' || doc_id END AS text FROM documents WHERE text <> '' UNION ALL SELECT doc_id, -1, 'Meeting: M' || doc_id FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, i, CASE WHEN regexp_matches(l, '^#{{1,3}} ') THEN regexp_replace(l, '^#{{1,3}} ', '') ELSE l END FROM l WHERE NOT regexp_full_match(l, '[ \t\n\f\r\v]*'))
SELECT doc_id AS result_id, md5(string_agg(text, chr(10) ORDER BY i)) AS docx_text, md5({PDF_SQL.format(t="string_agg(text, chr(10) ORDER BY i)")}) AS pdf_text FROM b GROUP BY 1""", views=False)
def action_files(spark, sf):
    """Word-processor and page files of action results (every document is one): their texts as read back from the files."""
    head = lambda x, i: F.concat(F.when((i + 1) % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + (i + 1) % 4).cast("int")), F.lit(" "))).otherwise(""), x)
    d = V.table(spark, sf, "documents").where("text <> ''").select(
        F.col("doc_id").alias("result_id"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Summary "), "doc_id")).alias("action_name"), F.concat(F.lit("M"), "doc_id").alias("title"),
        F.array_join(F.transform(F.split("text", "\n"), head), "\n").alias("result_text"),
    )
    return _file_texts(office.document_files(render.action_file_blocks(d), "result_id"), "result_id")


@query("""WITH d AS (SELECT doc_id, CASE WHEN octet_length(encode(text)) % 2 = 0 THEN text ELSE text || ' ' END AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, hex(encode(t)) AS body, octet_length(encode(t)) AS n FROM d),
b AS (SELECT *, printf('%08X', n) AS dn, printf('%08X', n + 36) AS rn FROM s)
SELECT doc_id, n + 44 AS bytes, md5('52494646' || substring(rn, 7, 2) || substring(rn, 5, 2) || substring(rn, 3, 2) || substring(rn, 1, 2) || '57415645666D7420100000000100010080' || '3E0000007D00000200100064617461' || substring(dn, 7, 2) || substring(dn, 5, 2) || substring(dn, 3, 2) || substring(dn, 1, 2) || body) AS digest FROM b""", views=False)
def audio_files(spark, sf):
    """Audio files of sample bytes, compared byte by byte (every text stands for samples, padded to whole ones)."""
    even = F.when(F.octet_length("text") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    d = V.table(spark, sf, "documents").where("text is not null").select("doc_id", office.wav_file(even.cast("binary")).alias("w"))
    return d.select("doc_id", F.octet_length("w").cast("long").alias("bytes"), F.md5(F.hex("w")).alias("digest"))


# --- model inputs and answers -----------------------------------------------------------------------------

def cut_sql(t: str, mark: str = "transcription") -> str:
    return f"CASE WHEN length({t}) > 15000 THEN substring({t}, 1, 15000) || chr(10) || chr(10) || '[...{mark} truncated...]' ELSE {t} END"


TOLD_SQL = NAME_SQL + """, t AS (SELECT meeting_id, string_agg('[' || printf('%.1f', round_even(start_time, 1)) || 's] [' || name || ']: ' || text, chr(10) ORDER BY ord) AS i, string_agg('[' || name || ']: ' || text, chr(10) ORDER BY ord) AS a,
  string_agg('[' || CAST(floor(start_time / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(start_time) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] [' || name || ']: ' || text, chr(10) ORDER BY ord) AS p FROM n GROUP BY 1)"""


@query(TOLD_SQL + f""", u AS (SELECT s.meeting_id, string_agg('[' || coalesce(p.label, 'UNKNOWN') || ']: ' || text, chr(10) ORDER BY ord) AS o FROM seg s LEFT JOIN spk p USING (meeting_id, speaker_id) WHERE start_time < 120 GROUP BY 1)
SELECT meeting_id, {cut_sql('i')} AS insights, {cut_sql('a')} AS action, o AS intro FROM t LEFT JOIN u USING (meeting_id)""")
def model_transcripts(spark, sf):
    s, p = V.segments(spark, sf), V.speakers(spark, sf)
    text = lambda style, **how: analytics.transcript_text(s, p, style, **how).withColumnRenamed("transcript", style if style != "intro" else "intro")
    return text("insights").join(text("action"), "meeting_id").join(text("intro", limit=10**9, until=120.0), "meeting_id", "left")


PROTOCOL_INPUT_SQL = f"""'Meeting title: ' || m.title || chr(10) || 'Date: ' || strftime(m.created_at, '%Y-%m-%d') || chr(10) || 'Duration: ' || CAST(floor(m.duration / 60) AS BIGINT) || ' minutes' || chr(10) || 'Attendees: ' || (SELECT string_agg(coalesce(display_name, label), ', ' ORDER BY label) FROM spk q WHERE q.meeting_id = m.meeting_id) || chr(10) || chr(10) || 'Transcript:' || chr(10) || {cut_sql('t.p', 'transcript')}"""


def _echo(*told):
    """A stand-in for a model: fails on some inputs, else answers with the length and the start of what it was told."""
    if len(told[-1]) % 5 == 0:
        raise ValueError("no answer")
    return f"{len(told[-1])} {' '.join(told)[:40]}"


@query(TOLD_SQL + f""", i AS (SELECT m.meeting_id, {PROTOCOL_INPUT_SQL} AS x FROM mtg m JOIN t USING (meeting_id))
SELECT m.meeting_id, CASE WHEN m.meeting_id % 3 <> 0 AND length(x) % 5 <> 0 THEN length(x) || ' ' || substring(x, 1, 40) WHEN m.meeting_id % 2 = 0 THEN 'old' END AS protocol_text FROM mtg m LEFT JOIN i USING (meeting_id)""")
def protocol_texts(spark, sf):
    """Protocols of completed recordings; a failed call keeps what there was."""
    k = F.col("meeting_id")
    m = V.meetings(spark, sf).withColumns({"status": F.when(k % 3 == 0, "recording").otherwise("completed"), "protocol_text": F.when(k % 2 == 0, "old")})
    return jobs.write_protocols(m, V.segments(spark, sf), V.speakers(spark, sf), _echo).select("meeting_id", "protocol_text")


@query(TOLD_SQL + f""", i AS (SELECT m.meeting_id, 'Meeting title: ' || m.title || chr(10) || chr(10) || 'Transcription:' || chr(10) || {cut_sql('t.a')} AS x FROM mtg m JOIN t USING (meeting_id))
SELECT action_id, meeting_id, CASE WHEN length(x) % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN length(x) % 5 <> 0 THEN length(x) || ' ' || substring(prompt || ' ' || x, 1, 40) END AS result_text FROM i, (SELECT r_regionkey AS action_id, 'Do ' || r_name AS prompt FROM region)""")
def action_runs(spark, sf):
    a = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("action_id"), F.concat(F.lit("Do "), "r_name").alias("prompt"))
    return jobs.run_action(V.meetings(spark, sf), V.segments(spark, sf), V.speakers(spark, sf), a, _echo)


@query("""SELECT meeting_id, i AS ord, 'decision' AS insight_type, CASE WHEN meeting_id % 3 = 0 THEN 'new ' || i ELSE 'old ' || i END AS content FROM mtg, range(0, 3) g(i) WHERE meeting_id % 3 <> 0 OR i <= meeting_id % 2""")
def insight_replacement(spark, sf):
    """Insights of the recordings that were analysed again are replaced, those of others stay."""
    m = V.meetings(spark, sf).select("meeting_id")
    old = m.select("meeting_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("meeting_id", F.col("i").cast("long").alias("ord"), F.lit("decision").alias("insight_type"), F.concat(F.lit("old "), "i").alias("content"))
    item = F.transform(F.sequence(F.lit(0).cast("long"), F.col("meeting_id") % 2), lambda i: F.struct(F.concat(F.lit("new "), i.cast("string")).alias("content")))
    answers = m.where("meeting_id % 3 = 0").select("meeting_id", F.to_json(F.struct(item.alias("decisions"))).alias("answer"))
    return jobs.extract_insights(old, answers).select("meeting_id", F.col("ord").cast("long").alias("ord"), "insight_type", "content")


@query("""SELECT meeting_id, count(*) AS speakers, string_agg('[' || label || '] (' || n || ' segment): ' || CASE WHEN length(t) > 800 THEN substring(t, 1, 800) || '...' ELSE t END, chr(10) || chr(10) ORDER BY label) AS prompt FROM (
SELECT s.meeting_id, p.label, count(*) AS n, string_agg(s.text, ' ' ORDER BY ord) AS t FROM seg s JOIN spk p USING (meeting_id, speaker_id) GROUP BY 1, 2) GROUP BY 1""".replace(", p.label, count", ", p.label, count"))
def polish_prompts(spark, sf):
    return jobs.polish_prompts(V.segments(spark, sf), V.speakers(spark, sf)).withColumn("speakers", F.col("speakers").cast("long"))


@query(CHUNK_SQL.replace("SELECT r.meeting_id, r.chunk, string_agg", ", c AS (SELECT r.meeting_id, r.chunk, string_agg") + """), p AS (SELECT meeting_id, chunk, '[' || printf('%.0f', round_even(start_time, 0)) || 's - ' || printf('%.0f', round_even(end_time, 0)) || 's]' || chr(10) || text AS prompt FROM c),
a AS (SELECT *, prompt || CASE WHEN chunk % 3 <> 1 THEN chr(10) || 'answer ' || chunk ELSE '' END AS turn FROM p)
SELECT meeting_id, chunk, prompt, coalesce(string_agg(turn, chr(10)) OVER (PARTITION BY meeting_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM a""")
def intro_conversation(spark, sf):
    c = chunks.time_chunks(V.segments(spark, sf))
    return models.conversation(c, c.where("chunk % 3 <> 1").select("meeting_id", "chunk", F.concat(F.lit("answer "), "chunk").alias("answer")))


@query(CHUNK_SQL.replace("SELECT r.meeting_id, r.chunk, string_agg", ", c AS (SELECT r.meeting_id, r.chunk, string_agg") + """), a AS (SELECT meeting_id, chunk, end_time FROM c WHERE chunk % 4 <> 1)
SELECT meeting_id, max(chunk) + 1 AS speaker_count, string_agg('N' || (chunk % 3), ',' ORDER BY chunk) FILTER (chunk < 6 AND chunk IN (SELECT min(b.chunk) FROM a b WHERE b.meeting_id = a.meeting_id GROUP BY b.chunk % 3)) AS names, min(CASE WHEN chunk % 5 = 3 THEN end_time END) AS intro_end_time FROM a GROUP BY 1""")
def intro_results(spark, sf):
    """Answers of the introduction analysis gathered: the last count, all names in order, the end."""
    c = chunks.time_chunks(V.segments(spark, sf)).where("chunk % 4 <> 1")
    answer = F.to_json(F.struct((F.col("chunk") + 1).alias("speaker_count"), F.array(F.concat(F.lit("N"), F.col("chunk") % 3)).alias("names"), (F.col("chunk") % 5 != 3).alias("intro_ongoing")))
    r = models.intro_result(c.select("meeting_id", "chunk", "end_time", answer.alias("answer")))
    return r.select("meeting_id", "speaker_count", F.array_join("names", ",").alias("names"), "intro_end_time")


@query("""SELECT meeting_id, ord, CASE WHEN ord % 4 < 3 AND ord % 7 = 6 THEN '[' || (ord * 1000000000000000000000::HUGEINT) || ',true]' WHEN ord % 4 < 3 THEN '{"Zoë":2.5,"a":[' || (ord * 1000000000000000000000::HUGEINT) || ',true],"meeting":' || meeting_id || '}' END AS answer FROM seg""")
def llm_json(spark, sf):
    """Values wrapped in four ways, keys out of order, large numbers; where one is not finite, only the list inside is JSON."""
    s = V.segments(spark, sf)
    big = F.concat(F.col("ord").cast("string"), F.when(F.col("ord") > 0, "0" * 21).otherwise(""))
    tail = F.when(F.col("ord") % 7 == 6, F.when(F.col("ord") % 2 == 0, "1e400").otherwise("NaN")).otherwise("2.50")
    body = F.concat(F.lit('{"meeting": '), "meeting_id", F.lit(', "a": ['), big, F.lit(', true], "Zoë": '), tail, F.lit("}"))
    wrapped = F.when(F.col("ord") % 4 == 0, body).when(F.col("ord") % 4 == 1, F.concat(F.lit("<think>no {</think>```json\n"), body, F.lit("\n```"))).when(F.col("ord") % 4 == 2, F.concat(F.lit("Here [it is: "), body, F.lit(" end"))).otherwise("none")
    return s.select("meeting_id", "ord", learned.answer_json(wrapped).alias("answer"))


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), """ + told_apart("d", "doc_id", 0, 3) + """
SELECT term, count(*) AS frequency, min(doc_id) AS source_meeting_id FROM (SELECT doc_id, 'Qx' || doc_id % 7 AS term FROM good UNION ALL SELECT doc_id, 'Qy Zoë' FROM good) GROUP BY 1""", views=False)
def vocab_learn(spark, sf):
    """Edits of whole texts of any length: a word put before the first and two after the last; the words between are equal."""
    d = V.table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    edited = F.concat(F.lit("Qx"), F.col("doc_id") % 7, F.lit(" "), "text", F.lit(" Qy Zoë"))
    return vocabulary.learn(d.select(F.col("doc_id").alias("meeting_id"), F.col("text").alias("old_text"), edited.alias("new_text")))


@query(r""", d AS (SELECT meeting_id, ord, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS w FROM seg), """ + told_apart("d", "meeting_id, ord", 1, 0) + """,
t AS (SELECT meeting_id, 'Qr' || ord % 5 || 'ed' AS term, w[1] AS was FROM good WHERE w[1] <> w[2])
SELECT term, count(*) AS frequency, min(meeting_id) AS source_meeting_id FROM t WHERE abs(length(term) - length(was)) < length(was) GROUP BY 1""")
def vocab_replaced(spark, sf):
    """Edits of utterances: the first word replaced by another; it is learned if its length is near the old one's."""
    w = F.filter(F.split(F.trim(F.col("text")), r"\s+"), lambda x: x != "")
    d = V.segments(spark, sf).select("meeting_id", "ord", "text", w.alias("w")).where("size(w) > 1 and w[0] <> w[1]")
    term = F.concat(F.lit("Qr"), F.col("ord") % 5, F.lit("ed"))
    edited = F.array_join(F.concat(F.array(term), F.slice("w", 2, F.size("w"))), " ")
    return vocabulary.learn(d.select("meeting_id", F.col("text").alias("old_text"), edited.alias("new_text")))


@query("SELECT p_partkey AS k, p_name = lower(p_name) AND p_name <> upper(p_name) AS words, false AS digits FROM part", views=False)
def lower_case_tests(spark, sf):
    from parlance.functions import exprs as X

    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), X.is_lower("p_name").alias("words"), X.is_lower(F.col("p_size").cast("string")).alias("digits"))


# --- nested rows, flags, small aggregates -----------------------------------------------------------------


@query("""SELECT m.meeting_id, (SELECT count(*) FROM spk p WHERE p.meeting_id = m.meeting_id) AS speakers, (SELECT string_agg(label, ',' ORDER BY label) FROM spk p WHERE p.meeting_id = m.meeting_id) AS labels, (SELECT count(*) FROM seg s WHERE s.meeting_id = m.meeting_id) AS segments, (SELECT md5(string_agg(text, '|' ORDER BY ord)) FROM seg s WHERE s.meeting_id = m.meeting_id) AS texts FROM mtg m""")
def nested_meetings(spark, sf):
    n = analytics.nested(V.meetings(spark, sf), V.speakers(spark, sf), V.segments(spark, sf))
    joined = lambda c, f, sep: F.array_join(F.transform(c, lambda x: x[f]), sep)
    return n.select("meeting_id", F.size("speakers").cast("long").alias("speakers"), joined("speakers", "label", ",").alias("labels"), F.size("segments").cast("long").alias("segments"), F.md5(joined("segments", "text", "|")).alias("texts"))


@query("SELECT meeting_id, ord, coalesce(confidence < 0.6, false) AS low_confidence FROM seg")
def low_confidence(spark, sf):
    return analytics.flagged(V.segments(spark, sf)).select("meeting_id", "ord", "low_confidence")


@query("""SELECT s.meeting_id, s.speaker_id, min(ord) AS first_ord, arg_min(coalesce(display_name, label), ord) AS name, sum(end_time - start_time) AS seconds, count(*) AS utterances, (['#6366f1', '#ec4899', '#10b981'])[CAST(s.speaker_id % 10 + 1 AS INTEGER)] AS color FROM seg s JOIN spk p USING (meeting_id, speaker_id) GROUP BY 1, 2""")
def live_colours(spark, sf):
    palette = F.array(*map(F.lit, schemas.PALETTE))
    p = V.speakers(spark, sf).withColumn("color", F.element_at(palette, (F.col("speaker_id") % 10 + 1).cast("int")))
    return analytics.live_colours(V.segments(spark, sf), p)


@query("SELECT o_custkey AS meeting_id, count(*) FILTER (o_orderkey % 3 = 0) AS decisions, count(*) FILTER (o_orderkey % 3 = 1) AS action_items, count(*) FILTER (o_orderkey % 3 = 2) AS open_questions, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders GROUP BY 1", views=False)
def insight_counts(spark, sf):
    k = F.col("o_orderkey") % 3
    return analytics.insights_by_type(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("meeting_id"), F.when(k == 0, "decision").when(k == 1, "action_item").otherwise("open_question").alias("insight_type"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status")))


@query("""WITH c AS (SELECT o_custkey AS host, CASE o_orderkey % 4 WHEN 0 THEN 'disk_free_gb' ELSE 'check' || o_orderkey END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'low' WHEN o_orderkey % 9 = 1 THEN 'error' WHEN o_orderkey % 9 = 2 THEN NULL ELSE 'ok' END AS value FROM orders)
SELECT host, CASE WHEN coalesce(bool_and(coalesce(value = 'ok', false)) FILTER (name <> 'disk_free_gb'), true) THEN 'ok' ELSE 'degraded' END AS status, bool_or(value = 'ok') AS any_ok FROM c GROUP BY 1""", views=False)
def health_checks(spark, sf):
    k = F.col("o_orderkey")
    c = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("host"), F.when(k % 4 == 0, "disk_free_gb").otherwise(F.concat(F.lit("check"), k)).alias("name"), F.when(k % 4 == 0, "low").when(k % 9 == 1, "error").when(k % 9 == 2, F.lit(None)).otherwise("ok").alias("value"))
    return analytics.health(c)


@query("SELECT meeting_id, lab AS label, arg_max(ds, struct_pack(d := de - ds, o := -di)) AS ds, arg_max(de, struct_pack(d := de - ds, o := -di)) AS de, least(max(de - ds), 15) AS clip FROM diar GROUP BY 1, 2 HAVING max(de - ds) >= 2")
def longest_turns(spark, sf):
    return speakers.longest_turn(V.turns(spark, sf))


@query("""SELECT 'profile' AS kind, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS place FROM customer UNION ALL SELECT 'insight', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) FROM orders""", views=False)
def ordered_lists(spark, sf):
    """Lists in their orders: profiles by name, insights by time."""
    c = mutate.placed(V.table(spark, sf, "customer"), "c_nationkey", "c_name", "c_custkey").select(F.lit("profile").alias("kind"), F.col("c_custkey").alias("id"), "place")
    o = mutate.placed(V.table(spark, sf, "orders"), "o_custkey", F.desc("o_orderdate"), "o_orderkey").select(F.lit("insight").alias("kind"), F.col("o_orderkey").alias("id"), "place")
    return c.unionByName(o)


def _listener(history: str, prompt: str) -> str:
    """A stand-in for the model that reads introductions: its answer follows from the chunk's length; some calls fail."""
    text = prompt.split("\n", 1)[1]
    if len(text) % 11 == 5:
        raise ValueError("no answer")
    start = "Well: " if len(text) % 2 else ""
    return f'{start}{{"intro_ongoing": {"true" if len(text) % 3 else "false"}, "speaker_count": {len(text) % 7}, "names": ["N{len(text) % 13}"]}}'


@query(CHUNK_SQL.replace("SELECT r.meeting_id, r.chunk, string_agg", ", c AS (SELECT r.meeting_id, r.chunk, string_agg") + """),
l AS (SELECT meeting_id, chunk, end_time, length(text) AS n FROM c WHERE chunk < 20),
o AS (SELECT *, n % 11 = 5 AS failed, coalesce(bool_and(n % 11 = 5 OR n % 3 <> 0) OVER (PARTITION BY meeting_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS asked FROM l),
k AS (SELECT meeting_id, max(chunk) FILTER (NOT failed) AS last, count(*) AS asked FROM o WHERE asked GROUP BY 1)
SELECT k.meeting_id, coalesce(n % 7, 0) AS speaker_count, coalesce('N' || n % 13, '') AS names, end_time AS intro_end_time, asked FROM k LEFT JOIN l ON l.meeting_id = k.meeting_id AND l.chunk = k.last""")
def intro_rounds(spark, sf):
    """The introduction's conversation in rounds: a recording is asked about until its introduction is over."""
    r = models.intro_rounds(chunks.time_chunks(V.segments(spark, sf)), _listener, tries=1)
    return r.select("meeting_id", F.col("speaker_count").cast("long").alias("speaker_count"), F.array_join("names", ",").alias("names"), "intro_end_time", F.col("asked").cast("long").alias("asked"))
