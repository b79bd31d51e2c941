"""Text queries: cleaning, sections, chunks, gates, citations, prompts, JSON repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking, gap, prompts
from siltstone.session import spread

from .common import SQL_EXCHANGES, WS, exchanges, sql_garbled, sql_overlap, sql_split, sql_strip, sql_tokenise, table


#: Tokens of the chunks here: documents are short.
LEAST, MOST = 64, 128


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.is_garbled(F.col("text")).alias("garbled"))


def tokenise(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokenise(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = T.clean_page(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.length(c).cast("bigint").alias("n"), F.md5(c.cast("binary")).alias("digest"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("digest"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a document as its pages."""
    lines = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return lines.select("doc_id", (F.col("p") + 1).cast("bigint").alias("page"), "text", F.col("text").contains("|").alias("has_table"))


def section_assign(spark: SparkSession, d: str) -> DataFrame:
    s = chunking.near_tables(chunking.sections(_pages(spark, d)))
    return s.groupBy("doc_id", "section", "page_start").agg(F.count("*").alias("pages"), F.count_if("is_table").alias("tables"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Greedy chunks of the cleaned texts."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.clean_page(F.col("text")).alias("text"))
    return chunking.chunks(docs, least=LEAST, most=MOST)


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table of documents whose lines are their pages: sections (every second page opens one), chunks, numbers through a document, provenance."""
    titled = F.when(F.col("page") % 2 == 0, F.concat(F.lit("Chapter "), F.col("page"), F.lit(" Findings\n"), F.col("text"))).otherwise(F.col("text"))
    pages = _pages(spark, d).withColumn("text", T.clean_page(titled))
    docs = table(spark, d, "documents")
    meta = docs.select("doc_id", "source", F.lit("Report").alias("doc_type"), F.upper("lang").alias("language"), F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".pdf")).alias("file_path"), F.concat(F.col("doc_id"), F.lit(".pdf")).alias("file"))
    return chunking.page_chunks(pages, meta, least=LEAST, most=MOST).drop("processed_at")


def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.size(T.split_words(F.col("text"))).alias("tokens"))
    return chunking.corpus_report(docs, "lang", "NONE")


def query_classify(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.classify_query(F.col("text")).alias("kind"), T.slug(F.col("text")).alias("slug"), T.is_insufficient(F.col("text")).alias("insufficient"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Assistant texts with three citations: one twice, one without a dot, one that is none."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    cited = F.concat("text", F.format_string(" [doc_%d, p.%d] [doc_%d,p %d] [doc_%d, p.%d] [doc_9, p.x]", "conv_id", "turn", F.col("conv_id") + 1, F.col("turn") * 2, "conv_id", "turn"))
    return c.select("conv_id", "turn", cited.alias("answer"))


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).select("conv_id", "turn", F.explode(T.citations(F.col("answer"))).alias("c")).select("conv_id", "turn", "c.doc", "c.page")


def citation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A citation is right if its document has a page within two of the one named."""
    cites = _cited(spark, d).select("conv_id", "turn", F.posexplode(T.citations(F.col("answer"))).alias("i", "c")).select("conv_id", "turn", "i", "c.doc", "c.page")
    pages = table(spark, d, "conversations").where("role = 'user'").select(F.format_string("doc_%d", "conv_id").alias("doc"), F.col("turn").alias("known"))
    met = cites.join(pages, "doc", "left").groupBy("conv_id", "turn", "i").agg(F.coalesce(F.max((F.abs(F.col("known") - F.col("page")) <= 2).cast("int")), F.lit(0)).alias("ok"))
    return met.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum("ok").alias("correct"), (F.sum("ok") / F.count("*")).alias("accuracy"))


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Event properties in the shapes that models write them in, read back."""
    e = spread(table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "props"))
    p = F.col("props")
    broken = F.array(p, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```")), F.concat(F.lit("so "), p, F.lit(" done")), F.regexp_replace(F.translate(p, '"', "'"), r"\}$", ",}"), F.lit("nothing"))
    rows = e.select("event_id", F.posexplode(broken).alias("shape", "raw"))
    return rows.select("event_id", F.col("shape").cast("bigint").alias("shape"), T.repair_json(F.col("raw")).alias("repaired"))


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A context of each conversation's turns as sources, and the message around it."""
    c = table(spark, d, "conversations")
    null = lambda t: F.lit(None).cast(t)
    chunks = c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("bigint").alias("rank"), F.format_string("doc_%d", "turn").alias("doc_id"), null("string").alias("country"), null("int").alias("year"), F.col("turn").cast("int").alias("page"), F.col("role").alias("section"), F.lit("chat").alias("source"), "text")
    blocks = prompts.context_block(chunks, text_chars=800)
    message = prompts.user_message(F.col("context"), F.lit("What is the gap?"), T.classify_query(F.lit("What is the gap?")))
    return blocks.select("query_id", F.length("context").cast("bigint").alias("n"), F.md5(F.col("context").cast("binary")).alias("digest"), F.length(T.trim_prompt(message)).cast("bigint").alias("message_chars"))


def inst_prompts(spark: SparkSession, d: str) -> DataFrame:
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m"))
    p = T.inst_prompt(F.col("m"))
    return rows.select("conv_id", F.length(p).cast("bigint").alias("n"), F.md5(p.cast("binary")).alias("digest"))


def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each reply judged by word overlap with the question; rates of each reply."""
    from siltstone.operators.evaluation import hallucination

    claims = exchanges(spark, d).select("id", F.col("ref").alias("context"), F.explode(T.claims(F.col("hyp"))).alias("claim"))
    return hallucination(prompts.judge_overlap(claims, 0.2)).select("id", "n_claims", F.round("hallucination_rate", 6).alias("hallucination_rate"), F.round("grounding_score", 6).alias("grounding_score"))


def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of texts with the same first 100 characters the first stays."""
    docs = table(spark, d, "documents").withColumn("start", F.substring("text", 1, 100))
    return gap.keep_first(docs, ["start"], F.col("doc_id")).select("doc_id", "start")


def relevance_band(spark: SparkSession, d: str) -> DataFrame:
    """Lines within one of the line that a question names, in the document that it names."""
    gold = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.length("text") % 7 + 1).alias("source_page"))
    pages = _pages(spark, d).select("doc_id", "page")
    return pages.join(gold, (F.col("doc_id") == F.col("query_id")) & (F.abs(F.col("page") - F.col("source_page")) <= 1)).select("query_id", "doc_id", "page")


#: Retrieved rows that may be broadcast; beyond it they and the texts are shuffled.
BROADCAST_HITS = 1_000_000


def rag_answers(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval, prompt, stand-in model, citations: the whole answering plan; rows only."""
    from .retrieval import bm25_topk

    top = bm25_topk(spark, d).where("rank <= 5")
    # five rows a question are few: they go to the texts, which then stay where they are
    if 5 * table(spark, d, "benchmark").count() <= BROADCAST_HITS:
        top = F.broadcast(top)
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("country"), "source", "text")
    null = F.lit(None)
    chunks = top.join(docs, "doc_id").select("query_id", "rank", F.col("doc_id").cast("string"), "country", null.cast("int").alias("year"), F.lit(1).alias("page"), null.cast("string").alias("section"), "source", "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(prompts.context_block(chunks, 800), "query_id", "left")
    asked = asked.withColumn("prompt", prompts.user_message(F.col("context"), F.col("text"), T.classify_query(F.col("text"))))
    answers = prompts.generate(asked.select("query_id", "prompt"))
    return answers.select("query_id", "answer", T.is_insufficient(F.col("answer")).alias("insufficient"), F.size(T.citations(F.col("answer"))).alias("n_citations"), "error")


QUERIES = {f.__name__: f for f in (quality_gate, tokenise, clean_text, sentence_split, section_assign, chunk_documents, page_chunks, corpus_report, query_classify, citation_extract, citation_accuracy, json_repair, context_blocks, inst_prompts, claim_verdicts, keep_first_dedup, relevance_band, rag_answers)}


def _sql_clean(x: str) -> str:
    for k, v in T.LIGATURES.items():
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    for p in T.NOISE:
        x = f"regexp_replace({x}, '{p.replace('(?md', '(?m')}', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(x)


_HEADING = T.HEADING.replace("'", "''")
_HIDDEN = f"""list_aggregate(list_transform(string_split(regexp_replace(text, '({T.ABBREVIATIONS})', chr(2) || '\\1' || chr(3), 'g'), chr(2)),
  lambda p: CASE WHEN strpos(p, chr(3)) > 0 THEN replace(string_split(p, chr(3))[1], '.', chr(1)) || string_split(p, chr(3))[-1] ELSE p END), 'string_agg', '')"""
_SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({_HIDDEN}, '([.!?]){WS}+([A-Z0-9"(])', '\\1' || chr(30) || '\\2', 'g'), '\\n\\n+', chr(30), 'g'), chr(30)),
  lambda p: {sql_strip("replace(p, chr(1), '.')")}), lambda p: p <> '')"""
_PAGES = "pg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


def _any(q: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"


_CITED = """a AS (SELECT conv_id, turn, text || format(' [doc_{}, p.{}] [doc_{},p {}] [doc_{}, p.{}] [doc_9, p.x]', conv_id, turn, conv_id + 1, turn * 2, conv_id, turn) AS answer FROM conversations WHERE role = 'assistant'),
c AS (SELECT DISTINCT conv_id, turn, doc, page::BIGINT AS page FROM (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '#pattern#', 1)) AS doc, unnest(regexp_extract_all(answer, '#pattern#', 2)) AS page FROM a))""".replace("#pattern#", T.CITATION)
_BRACES = "CASE WHEN strpos(X, '{') > 0 AND strpos(X, '}') > 0 AND length(X) - strpos(reverse(X), '}') + 1 > strpos(X, '{') THEN substr(X, strpos(X, '{'), length(X) - strpos(reverse(X), '}') + 2 - strpos(X, '{')) END"
_FIXED = f"translate(regexp_replace(raw, ',{WS}*([}}\\]])', '\\1', 'g'), '''', '\"')"

# the fold as a reduction: a sentence is a state without chunks, held sentences or words; ``big`` marks one that must be cut
_EMPTY = "[]::STRUCT(t VARCHAR, n BIGINT)[]"
_SUM = "coalesce(list_sum(list_transform(X, lambda h: h.n)), 0)"
_JOIN = "coalesce(list_aggregate(list_transform(X, lambda h: h.t), 'string_agg', ' '), '')"
_HELD, _BUDGET = "a.held", int(MOST * chunking.OVERLAP)
_CARRIED = f"""list_slice({_HELD}, len({_HELD}) + 1 - len(list_filter(range(1, len({_HELD}) + 1), lambda k: {_SUM.replace('X', f'list_slice({_HELD}, len({_HELD}) + 1 - k, len({_HELD}))')} <= {_BUDGET})), len({_HELD}))"""
_EMITTED = f"CASE WHEN len({_HELD}) > 0 THEN list_append(a.done, {_JOIN.replace('X', _HELD)}) ELSE a.done END"


def _sql_chunks(source: str, by: str) -> str:
    """CTEs up to ``made`` (columns ``by``, done): the chunks of ``source`` (columns ``by``, text)."""
    return f"""parts AS (SELECT {by}, {_SENTENCES} AS parts FROM {source}),
states AS (SELECT {by}, list_transform(parts, lambda p: {{'done': []::VARCHAR[], 'held': {_EMPTY}, 't': p, 'w': {sql_split('p')}}}) AS s FROM parts WHERE len(parts) > 0),
folded AS (SELECT {by}, list_reduce(s, lambda a, x: CASE WHEN len(x.w) > {MOST}
    THEN {{'done': list_concat({_EMITTED}, list_transform(range(0, (len(x.w) - 1) // {MOST}), lambda i: list_aggregate(list_slice(x.w, i * {MOST} + 1, (i + 1) * {MOST}), 'string_agg', ' '))),
           'held': list_transform(list_slice(x.w, (len(x.w) - 1) // {MOST} * {MOST} + 1, len(x.w)), lambda t: {{'t': t, 'n': 1::BIGINT}}), 't': '', 'w': []::VARCHAR[]}}
    WHEN {_SUM.replace('X', _HELD)} + len(x.w) > {MOST} THEN {{'done': {_EMITTED}, 'held': list_append({_CARRIED}, {{'t': x.t, 'n': len(x.w)}}), 't': '', 'w': []::VARCHAR[]}}
    ELSE {{'done': a.done, 'held': list_append({_HELD}, {{'t': x.t, 'n': len(x.w)}}), 't': '', 'w': []::VARCHAR[]}} END,
  {{'done': []::VARCHAR[], 'held': {_EMPTY}, 't': '', 'w': []::VARCHAR[]}}) AS a FROM states),
rest AS (SELECT {by}, a.done AS done, {sql_strip(_JOIN.replace('X', 'a.held'))} AS t FROM folded),
made AS (SELECT {by}, CASE WHEN t = '' THEN done WHEN len(done) > 0 AND len({sql_split('t')}) < {LEAST // 2} AND len({sql_split("done[-1] || ' ' || t")}) <= {MOST * 1.2}
  THEN list_append(list_slice(done, 1, len(done) - 1), done[-1] || ' ' || t) ELSE list_append(done, t) END AS done FROM rest)"""


_CLEAN_PAGES = f"pc AS (SELECT doc_id, page, {_sql_clean('text')} AS text, contains(text, '|') AS has_table FROM titled)"
_TITLED = "titled AS (SELECT doc_id, page, CASE WHEN page % 2 = 0 THEN 'Chapter ' || page || ' Findings' || chr(10) || text ELSE text END AS text FROM pg)"
_ROW = f"len({sql_split('c')}) AS token_count, length(c) AS char_count"

ORACLE_SQL = {
    "chunk_documents": f"""WITH d AS (SELECT doc_id, {_sql_clean("coalesce(text, '')")} AS text FROM documents), {_sql_chunks('d', 'doc_id')},
      c AS (SELECT doc_id, unnest(done) AS c, generate_subscripts(done, 1) - 1 AS i FROM made)
      SELECT doc_id, i AS chunk_index, format('{{}}__{{:05d}}', doc_id, i) AS chunk_id, c AS text, {_ROW} FROM c""",
    "page_chunks": f"""WITH {_PAGES}, {_TITLED}, {_CLEAN_PAGES}, h AS (SELECT *, {sql_strip('text')} AS st FROM pc),
      o AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_strip('l')}), lambda l: length(l) > 4 AND length(l) <= 120 AND regexp_matches(l, '{_HEADING}')) AS hs FROM h),
      w AS (SELECT *, coalesce(last_value(CASE WHEN len(hs) > 0 THEN substr(hs[-1], 1, 100) END IGNORE NULLS) OVER f, 'Introduction') AS section, coalesce(last_value(CASE WHEN len(hs) > 0 THEN page END IGNORE NULLS) OVER f, 1) AS page_start,
        bool_or(has_table) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS is_table FROM o WINDOW f AS (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING)),
      sec AS (SELECT * FROM (SELECT doc_id, section, page_start, arg_min(is_table, page) AS is_table, {sql_strip("string_agg(text, chr(10) ORDER BY page)")} AS text FROM w GROUP BY doc_id, section, page_start) WHERE text <> ''),
      {_sql_chunks('sec', 'doc_id, section, page_start, is_table')},
      n AS (SELECT *, coalesce(sum(len(done)) OVER (PARTITION BY doc_id ORDER BY page_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM made),
      c AS (SELECT doc_id, section, page_start, is_table, unnest(done) AS c, first + generate_subscripts(done, 1) - 1 AS chunk_index FROM n)
      SELECT format('{{}}__{{:05d}}', doc_id, chunk_index) AS chunk_id, doc_id, b.source, 'Report' AS doc_type, NULL::VARCHAR AS country, NULL::INTEGER AS ndc_cycle, NULL::INTEGER AS year, upper(b.lang) AS language, NULL::INTEGER AS emissions_rank, NULL::BOOLEAN AS withdrawn,
        NULL::BOOLEAN AS superseded, NULL::VARCHAR AS note, NULL::VARCHAR AS wg, NULL::INTEGER AS chapter, NULL::VARCHAR AS relevance, doc_id || '.pdf' AS file, b.source || '/' || doc_id || '.pdf' AS file_path, section, page_start, {_ROW}, chunk_index, is_table, c AS text, '1.0' AS pipeline_ver
      FROM c JOIN documents b USING (doc_id)""",
    "quality_gate": f"SELECT doc_id, {sql_garbled('text')} AS garbled FROM documents",
    "tokenise": f"SELECT doc_id, len(t) AS n, md5(coalesce(list_aggregate(t, 'string_agg', ' '), '')) AS digest FROM (SELECT doc_id, {sql_tokenise('text')} AS t FROM documents)",
    "clean_text": f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, {_sql_clean('text')} AS c FROM documents)",
    "sentence_split": f"SELECT doc_id, len(s) AS n, md5(coalesce(list_aggregate(s, 'string_agg', '|'), '')) AS digest FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)",
    "section_assign": f"""WITH {_PAGES}, h AS (SELECT *, {sql_strip('text')} AS s, contains(text, '|') AS has_table FROM pg),
      o AS (SELECT *, CASE WHEN length(s) > 4 AND length(s) <= 120 AND regexp_matches(s, '{_HEADING}') THEN substr(s, 1, 100) END AS own FROM h),
      w AS (SELECT doc_id, coalesce(last_value(own IGNORE NULLS) OVER f, 'Introduction') AS section, coalesce(last_value(CASE WHEN own IS NOT NULL THEN page END IGNORE NULLS) OVER f, 1) AS page_start,
        bool_or(has_table) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS is_table FROM o WINDOW f AS (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING))
      SELECT doc_id, section, page_start, count(*) AS pages, count(*) FILTER (is_table) AS tables FROM w GROUP BY ALL""",
    "corpus_report": f"""SELECT coalesce(lang, 'NONE') AS "group", count(*) AS n, count(DISTINCT doc_id) AS docs, sum(len({sql_split('text')}))::BIGINT AS tokens, floor(sum(len({sql_split('text')})) / count(*))::BIGINT AS mean_tokens FROM documents GROUP BY 1""",
    "query_classify": rf"""SELECT conv_id, turn, CASE WHEN {_any('lower(text)', T.GAP_WORDS)} THEN 'gap' WHEN {_any('lower(text)', T.COMPARATIVE_WORDS)} THEN 'comparative' ELSE 'factual' END AS kind,
      lower(regexp_replace(substr(text, 1, 40), '[^\p{{L}}\p{{N}}_]+', '_', 'g')) AS slug, starts_with(upper({sql_strip('text')}), 'INSUFFICIENT_CONTEXT') AS insufficient FROM conversations""",
    "citation_extract": f"WITH {_CITED} SELECT * FROM c",
    "citation_accuracy": f"""WITH {_CITED}, m AS (SELECT c.*, coalesce((SELECT max(CASE WHEN abs(u.turn - c.page) <= 2 THEN 1 ELSE 0 END) FROM conversations u WHERE u.role = 'user' AND 'doc_' || u.conv_id = c.doc), 0) AS ok FROM c)
      SELECT conv_id, turn, count(*) AS n, sum(ok)::BIGINT AS correct, sum(ok) / count(*) AS accuracy FROM m GROUP BY ALL""",
    "json_repair": f"""WITH r AS (SELECT event_id, unnest([props, 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```', 'so ' || props || ' done', regexp_replace(translate(props, '"', ''''), '\\}}$', ',}}'), 'nothing']) AS raw, unnest([0, 1, 2, 3, 4])::BIGINT AS shape FROM events),
      t AS (SELECT event_id, shape, [{sql_strip('raw')}, nullif(regexp_extract(raw, '(?s)```(?:json)?{WS}*(\\{{.*?\\}}){WS}*```', 1), ''), {_BRACES.replace('X', 'raw')}, {_BRACES.replace('X', _FIXED)}] AS tries FROM r)
      SELECT event_id, shape, list_filter(tries, lambda s: s IS NOT NULL AND json_valid(s))[1] AS repaired FROM t""",
    "context_blocks": """WITH b AS (SELECT conv_id, turn, '--- SOURCE ' || (turn + 1) || ' ---' || chr(10) || 'SOURCE ID : doc_' || turn || chr(10) || 'Country   : N/A  |  Year:   |  Page: ' || turn || chr(10) || 'Source    : chat' || chr(10) || 'Section   : ' || role || chr(10) || 'Content   :' || chr(10) || substr(trim(text, ' '), 1, 800) AS body FROM conversations),
      c AS (SELECT conv_id AS query_id, string_agg(body, chr(10) || chr(10) ORDER BY turn) AS context FROM b GROUP BY 1),
      m AS (SELECT *, length('RETRIEVED CONTEXT:') + 2 + length(context) + 2 + 60 + 1 + length('State what is missing.') + 1 + 1 + length('QUESTION: What is the gap?') + 2 + length('Answer (remember: use ONLY the context above, cite every claim as [doc_id, p.N]):') AS chars FROM c)
      SELECT query_id, length(context) AS n, md5(context) AS digest, CASE WHEN chars > 6000 THEN 4000 + 4 + length('[... context trimmed to fit the limit ...]') ELSE chars END AS message_chars FROM m""",
    "inst_prompts": """WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
      p AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN '[INST] ' || text || chr(10) || chr(10) WHEN 'user' THEN CASE WHEN before = 'system' THEN '' ELSE '[INST] ' END || text || ' [/INST]' WHEN 'assistant' THEN ' ' || text || ' </s><s>' ELSE '' END AS s FROM l),
      g AS (SELECT conv_id, '<s>' || string_agg(s, '' ORDER BY turn) AS prompt FROM p GROUP BY 1) SELECT conv_id, length(prompt) AS n, md5(prompt) AS digest FROM g""",
    "claim_verdicts": f"""WITH {SQL_EXCHANGES}, k AS (SELECT id, ref, unnest(list_slice(list_filter(list_transform(regexp_split_to_array(hyp, '[.!?]'), lambda p: {sql_strip('p')}), lambda p: length(p) > 20), 1, 8)) AS claim FROM ex),
      s AS (SELECT id, list_distinct({sql_overlap('claim')}) AS c, {sql_overlap('ref')} AS x FROM k),
      v AS (SELECT id, len(list_filter(c, lambda w: list_contains(x, w))) / greatest(len(c), 1) AS share FROM s),
      r AS (SELECT id, count(*) AS n, count(*) FILTER (share >= 0.8) AS s, count(*) FILTER (share >= 0.2 AND share < 0.8) AS p, count(*) FILTER (share < 0.2) AS u FROM v GROUP BY id)
      SELECT id, n AS n_claims, round(u / n, 6) AS hallucination_rate, round(greatest(0.0, least(1.0, (s + 0.5 * p) / n)), 6) AS grounding_score FROM r""",
    "keep_first_dedup": "SELECT min(doc_id) AS doc_id, substr(text, 1, 100) AS start FROM documents GROUP BY 2",
    "relevance_band": f"WITH {_PAGES} SELECT item_id AS query_id, doc_id, page FROM pg JOIN benchmark b ON doc_id = item_id AND abs(page - (length(b.text) % 7 + 1)) <= 1",
}
