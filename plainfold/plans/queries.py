"""One query for each operator that works on tables, with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plainfold.functions import prose as P
from plainfold.functions import rules as R
from plainfold.options import ABBREVIATIONS, Options
from plainfold.plans import api
from plainfold.sources.tables import table as _table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with ``plain``, the text of those that column expressions alone can reflow, else null."""
    d = _table(spark, sf_dir, "documents")
    return d.withColumn("plain", F.when(P.is_plain(F.col("text")), F.col("text")))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BAD = [P.MARKED, P.WIDE_SPACE, P.SPACED_LINE, P.MARKER_TOKEN, P.IMPORT_LINE]


def _plain_sql(col: str) -> str:
    return f"({col} is not null and " + " and ".join(f"not regexp_matches({col}, {_q(p)})" for p in _BAD) + ")"


#: plain documents with every paragraph on one line, chr(1) for newlines that stay
_JOINED = f"""p0 as (select doc_id, lang, source, text, replace(replace(text, chr(10) || chr(10), chr(1) || chr(1)), chr(1) || chr(10), chr(1) || chr(1)) as m from documents where {_plain_sql('text')}),
    p1 as (select *, case when starts_with(m, chr(10)) then chr(1) || substr(m, 2) else m end as m1 from p0),
    p2 as (select *, case when ends_with(m1, chr(10)) then left(m1, length(m1) - 1) || chr(1) else m1 end as m2 from p1),
    joined as (select doc_id, lang, source, text, regexp_replace(m2, ' *\\n', ' ', 'g') as line from p2),
    paras as (select doc_id, unnest(string_split(line, chr(1))) as para, generate_subscripts(string_split(line, chr(1)), 1) as para_no from joined)"""

_ABBR = ", ".join(_q(a) for a in ABBREVIATIONS)
_SENTENCES = f"""tokens as (select doc_id, para_no, unnest(string_split(para, ' ')) as token, generate_subscripts(string_split(para, ' '), 1) as pos from paras),
    marked as (select *, coalesce(regexp_matches(token, '[!.?…]+["'')’”\\]]*$') and lower(token) not in ({_ABBR}) and not regexp_matches(token, '^\\p{{Lu}}\\.$')
      and regexp_matches(lead(token) over w, '^["''“‘(\\[\\p{{Lu}}\\p{{Nd}}]'), false) as ends from tokens window w as (partition by doc_id, para_no order by pos)),
    numbered as (select *, coalesce(sum(ends::int) over (partition by doc_id, para_no order by pos rows between unbounded preceding and 1 preceding), 0) as nth from marked),
    sentences as (select doc_id, para_no, nth, string_agg(token, ' ' order by pos) as sentence from numbered group by all)"""


def _rebuilt(lines: str) -> str:
    """Texts of (doc_id, para_no, body) put together again."""
    return f"select doc_id, string_agg(body, chr(10) order by para_no) as formatted from ({lines}) group by doc_id"


def _stepped(source: str, keys: str, width: int, clauses: bool) -> str:
    """Lines of (keys, body) cut off one at a time."""
    clause = f"when regexp_matches(rest, '^.{{0,{width - 1}}}[,;] ') then regexp_extract(rest, '^(.{{0,{width - 1}}}[,;]) ', 1)" if clauses else ""
    line = f"case when length(rest) <= {width} then rest {clause} when regexp_matches(rest, '^.{{1,{width}}} ') then regexp_extract(rest, '^(.{{1,{width}}}) ', 1) else regexp_extract(rest, '^[^ ]+') end"
    return f"""cuts as (select {keys}, 0 as n, cast(null as varchar) as line, body as rest from {source}
      union all select {keys}, n + 1, {line}, substr(rest, length({line}) + 2) from cuts where rest <> ''),
    filled as (select {keys}, coalesce(string_agg(line, chr(10) order by n), '') as body from cuts group by {keys})"""


def doc_lines(spark, sf_dir):
    lines = F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    d = _table(spark, sf_dir, "documents").select("doc_id", lines)
    return d.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.length("line").cast("long").alias("width"))


def route_tier(spark, sf_dir):
    tables = (("documents", "text"), ("conversations", "text"), ("benchmark", "text"), ("pages", "html"))
    parts = [_table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), P.is_plain(F.col(c)).alias("plain")) for t, c in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("table_name", "plain").agg(F.count("*").alias("n"))


def _runs(lines: DataFrame) -> DataFrame:
    """Runs of lines (table_name, id, at, line) that are not blank, with 1-based first and last lines."""
    w = Window.partitionBy("table_name", "id").orderBy("at")
    runs = lines.withColumn("run", F.sum((F.trim("line") == "").cast("long")).over(w)).where(F.trim("line") != "").groupBy("table_name", "id", "run")
    return runs.agg((F.min("at") + 1).cast("long").alias("start_line"), (F.max("at") + 1).cast("long").alias("end_line")).drop("run")


def paragraph_runs(spark, sf_dir):
    """Runs of lines that are not blank, of documents as they stand and of pages with a line end after each closing tag."""
    docs = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    broken = F.regexp_replace("html", "(</[a-z0-9]+>)", "$1\n")
    pages = _table(spark, sf_dir, "pages").select(F.lit("pages").alias("table_name"), F.col("page_id").alias("id"), F.posexplode(F.split(broken, "\n", -1)).alias("at", "line"))
    return _runs(docs.unionAll(pages))


def _formatted(options: Options):
    """Every document through the engine's front door. Markdown is beyond SQL, so tests hold this against the kernel."""
    return lambda spark, sf_dir: api.reflow(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", options).select("doc_id", "formatted")


def _by_columns(options: Options):
    """The column expressions alone, over every document: null where the text isn't plain prose."""
    return lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", P.reflowed(F.col("plain"), options).alias("formatted"))


def sentence_rows(spark, sf_dir):
    """Sentences of plain documents; of the others the lines of the result, which for Markdown is what stands on a line."""
    d = api.reflow(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.explode(F.split("formatted", "\r?\n", -1)).alias("sentence")).where("sentence <> ''")


def prose_sentence_rows(spark, sf_dir):
    """Sentences of plain documents; one null for each other document."""
    lines = F.split(P.split_sentences(P.joined(F.col("plain"))), f"[\n{P.KEPT}]", -1)
    d = _documents(spark, sf_dir).select("doc_id", F.explode_outer(lines).alias("sentence"))
    return d.where("sentence is null or sentence <> ''")


def needs_format(spark, sf_dir):
    d = api.needs_format(_table(spark, sf_dir, "documents").select("lang", "text"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.col("needs_format").cast("long")).alias("n_changed"))


def prose_needs_format(spark, sf_dir):
    """By language: documents, plain ones, and plain ones that would change."""
    d = _documents(spark, sf_dir).select("lang", "plain", (P.reflowed(F.col("plain")) != F.col("plain")).alias("changes"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count("plain").alias("n_plain"), F.coalesce(F.sum(F.col("changes").cast("long")), F.lit(0)).alias("n_changed"))


def exit_code_by_source(spark, sf_dir):
    t = F.col("text")
    d = api.needs_format(_table(spark, sf_dir, "documents").select("source", "text")).select("source", t.isNull().alias("usage"), P.has_control(t).alias("refused"), F.col("needs_format").alias("changed"))
    return d.groupBy("source").agg(exit_code(F.col("usage"), F.col("refused"), F.col("changed")).alias("code"))


def abbrev_suppressed(spark, sf_dir):
    """How often an abbreviation stands where a sentence would else end; the table of them has a fixed size."""
    known = spark.createDataFrame([(a,) for a in ABBREVIATIONS], "token string")
    tokens = _table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[ \n]+")).alias("token")).where(F.col("token").endswith("."))
    return known.join(tokens.groupBy("token").agg(F.count("*").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def clause_breaks(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    all_, entity = F.regexp_count("text", F.lit(r"[,;][ \t\r]+")), F.regexp_count("text", F.lit(r"&#?[A-Za-z0-9]+;[ \t\r]+"))
    return d.select("doc_id", (all_ - entity).cast("long").alias("n_breaks"))


_SPANS = {"footnotes": r"\[\^[^\]\n]+\]", "maths": r"\$[^$\n]+\$", "shortcodes": r"\{{2}[%<].*?[>%]\}{2}", "braces": r"\{[^{}\n]+\}", "tags": r"</?[A-Za-z][^>\n]*>?"}


def regex_nobreak_spans(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    events = _table(spark, sf_dir, "events").select(F.lit("events").alias("table_name"), F.col("event_id").alias("id"), F.col("props").alias("t"))
    return docs.unionAll(events).select("table_name", "id", *[F.regexp_count("t", F.lit(p)).cast("long").alias(n) for n, p in _SPANS.items()])


_TRIGGERS = {
    "ordered": r"^[0-9]{1,9}[.)]([ \t\n\f\r]|$)",
    "heading": r"^#{1,6}([ \t\n\f\r]|$)",
    "quote": r"^>",
    "bullet": r"^[-*+]([ \t\n\f\r]|$)",
    "thematic": r"^ {0,3}((\*[ \t\r]*){3,}|(-[ \t\r]*){3,}|(_[ \t\r]*){3,})$",
    "setext": r"^ {0,3}=+[ \t\r]*$",
    "fence": r"^(```+[^`]*$|~~~)",
    "markup": r"^<[!?]",
    "delimiter_row": r"^[|]?[ \t]*:?-+:?[ \t]*([|][ \t]*:?-+:?[ \t]*)*[|]?[ \t\r]*$",
}


def line_triggers(spark, sf_dir):
    """Tokens that would begin a block if a cut put them first on a line, by rule."""
    tokens = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("token"))
    hits = [F.sum(F.col("token").rlike(p).cast("long")).alias(n) for n, p in _TRIGGERS.items()]
    return tokens.groupBy("doc_id").agg(*hits)


def front_matter_end(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    framed = d.select("doc_id", F.concat(F.lit("---\n"), "t", F.lit("\n---\nrest")).alias("t"))
    return d.withColumn("framed", F.lit(False)).unionAll(framed.withColumn("framed", F.lit(True))).select("doc_id", "framed", P.front_matter_lines(F.col("t")).alias("n_lines"))


def dialect_rule_hits(spark, sf_dir):
    rules = spark.createDataFrame([r[:3] for r in R.DIALECT_RULES], "rule string, pattern string, kind string")
    lines = _table(spark, sf_dir, "events").select("event_id", F.trim("props").alias("line"))
    hit = lines.join(F.broadcast(rules), F.expr("line rlike pattern"))  # seven rules, whatever the lines
    return hit.groupBy("rule", "kind").agg(F.count("*").alias("n"))


def explain_events(spark, sf_dir):
    words = spark.createDataFrame([(k, *v) for k, v in R.REASONS.items()], "reason string, detail string, remediation string")
    found = F.when(P.has_control(F.col("props")), "control-bytes")
    frozen = F.when(F.trim("props").rlike(R.DIALECT_RULES[4][1]), "dialect-block").otherwise(found)
    rows = _table(spark, sf_dir, "events").select("event_id", F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), frozen.alias("reason")).where("reason is not null")
    return rows.join(F.broadcast(words), "reason").select("event_id", "start_line", "end_line", "reason", "detail", "remediation")


def text_guards(spark, sf_dir):
    def part(table, key, col):
        t = F.col(col)
        return _table(spark, sf_dir, table).select(F.lit(table).alias("table_name"), P.has_control(t).alias("control"), F.is_valid_utf8(t).alias("valid"))

    d = part("documents", "doc_id", "text").unionAll(part("conversations", "conv_id", "text")).unionAll(part("pages", "page_id", "html"))
    return d.groupBy("table_name").agg(F.count("*").alias("n"), F.sum(F.col("control").cast("long")).alias("n_control"), F.sum(F.col("valid").cast("long")).alias("n_valid"))


def render_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", P.normalised_html(F.col("html")).alias("html"))


def extension_refused(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(ext.isin(*R.MARKDOWN), "markdown").when(ext.isin(*R.REFUSED), "refused").otherwise("unknown")


def input_refusal(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", extension_refused(path).alias("verdict"))


def exit_code(usage: Column, refused: Column, changed: Column) -> Column:
    """Severity, not number, decides: usage errors, then refusals, then files that would change."""
    return F.when(F.max(usage), 2).when(F.max(refused), 3).when(F.max(changed), 1).otherwise(0).cast("long")


def prose_exit_code_by_source(spark, sf_dir):
    """As if only plain documents could change; controls and missing texts count in all."""
    t = F.col("text")
    d = _documents(spark, sf_dir).select("source", t.isNull().alias("usage"), P.has_control(t).alias("refused"), F.coalesce(P.reflowed(F.col("plain")) != F.col("plain"), F.lit(False)).alias("changed"))
    return d.groupBy("source").agg(exit_code(F.col("usage"), F.col("refused"), F.col("changed")).alias("code"))


def canonical_width(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", P.canonical_width(F.col("text")).alias("width"))


#: Frozen paragraphs: what comes before and after the words, the lines that are frozen (0: none), and the reason.
_FROZEN = (
    ("Words with `x[0]: y` in", "", 1, 2, "link-ref-def-shape"),
    ("[a]: /u", "", 2, 2, "link-ref-def-neighbor"),
    ("See [x](<a b", "", 1, 2, "possible-link-ref-def"),
    ("Here <!DOCTYPE is", "", 1, 2, "raw-html-decl-opener"),
    ("<Widget a", ">", 1, 2, "unterminated-tag"),
    ("| a | b |\n|---|---|\n=", "", 3, 4, "table-adjacency"),
    ("> * > More", "", 1, 2, "deep-nesting"),
    ("Here \x01 is", "", 1, 2, "control-bytes"),
    ("More\n\u2003", "", 1, 3, "degenerate-blank"),
    ("$$", "\n$$", 1, 3, "dialect-block"),
    ("import A from b", "", 0, 0, ""),
    ("Only words", "", 0, 0, ""),
)


def explain_reasons(spark, sf_dir):
    """The words of every conversation turn in each surrounding that freezes a paragraph, and in two that don't."""
    turns = _table(spark, sf_dir, "conversations")
    words = F.concat(F.lit("word "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")))
    cases = F.array(*[F.struct(F.lit(i).cast("long").alias("case_no"), F.concat(F.lit(a + "\n"), words, F.lit(b + "\n")).alias("text")) for i, (a, b, *_) in enumerate(_FROZEN)])
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(cases).alias("c")).select("conv_id", "turn", "c.*")
    return api.explain(rows).select("conv_id", "turn", "case_no", "start_line", "end_line", "reason", "detail", "remediation")


def reflow_documents(spark, sf_dir):
    """Every document, plain or not, through the engine's front door."""
    return api.reflow(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "formatted")


def reflow_pages(spark, sf_dir):
    return api.reflow(_table(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", "formatted")


def explain_pages(spark, sf_dir):
    return api.explain(_table(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", "start_line", "end_line", "reason")


MODES = {"para_mode": Options("para"), "sentence_mode": Options(), "wrap80": Options("wrap"), "wrap40": Options("wrap", max_width=40), "sentence_mw80": Options("sentence", max_width=80)}

QUERIES = {
    "doc_lines": doc_lines,
    "route_tier": route_tier,
    "paragraph_runs": paragraph_runs,
    "sentence_rows": sentence_rows,
    "prose_sentence_rows": prose_sentence_rows,
    **{name: _formatted(o) for name, o in MODES.items()},
    **{f"prose_{name}": _by_columns(o) for name, o in MODES.items()},
    "needs_format": needs_format,
    "prose_needs_format": prose_needs_format,
    "prose_exit_code_by_source": prose_exit_code_by_source,
    "abbrev_suppressed": abbrev_suppressed,
    "clause_breaks": clause_breaks,
    "regex_nobreak_spans": regex_nobreak_spans,
    "line_triggers": line_triggers,
    "front_matter_end": front_matter_end,
    "dialect_rule_hits": dialect_rule_hits,
    "explain_events": explain_events,
    "explain_reasons": explain_reasons,
    "text_guards": text_guards,
    "render_normalize": render_normalize,
    "input_refusal": input_refusal,
    "exit_code_by_source": exit_code_by_source,
    "canonical_width": canonical_width,
    "reflow_documents": reflow_documents,
    "reflow_pages": reflow_pages,
    "explain_pages": explain_pages,
}

_SENTENCE_BODY = "select doc_id, para_no, string_agg(sentence, chr(10) order by nth) as body from sentences group by all"
_CODES = ", ".join(f"({_q(k)}, {_q(a)}, {_q(b)})" for k, (a, b) in R.REASONS.items())
_EXT = "lower(regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '\\.([^./]*)$', 1))"
_COUNT = lambda p, col="text": f"len(regexp_extract_all({col}, {_q(p)}))::bigint"
_SENTENCE_MODE = f"{_JOINED}, {_SENTENCES}, done as ({_rebuilt(_SENTENCE_BODY)})"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

ORACLES = {
    "doc_lines": "select doc_id, n as line_no, length(l)::bigint as width from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)",
    "route_tier": " union all ".join(f"select '{t}' as table_name, {_plain_sql(c)} as plain, count(*) as n from {t} group by 2" for t, c in (("documents", "text"), ("conversations", "text"), ("benchmark", "text"), ("pages", "html"))),
    "paragraph_runs": """with l as (select 'documents' as table_name, doc_id as id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
      union all select 'pages', page_id, unnest(s), generate_subscripts(s, 1) from (select page_id, string_split(regexp_replace(html, '(</[a-z0-9]+>)', '\\1' || chr(10), 'g'), chr(10)) as s from pages)),
      r as (select *, pos - row_number() over (partition by table_name, id order by pos) as run from l where trim(line) <> '')
      select table_name, id, min(pos) as start_line, max(pos) as end_line from r group by table_name, id, run""",
    "prose_para_mode": f"with {_JOINED} select d.doc_id, replace(line, chr(1), chr(10)) as formatted from documents d left join joined using (doc_id)",
    "prose_sentence_rows": f"with {_JOINED}, {_SENTENCES} select doc_id, sentence from sentences where sentence <> '' union all select doc_id, null from documents where not {_plain_sql('text')}",
    "prose_sentence_mode": f"with {_SENTENCE_MODE} select d.doc_id, formatted from documents d left join done using (doc_id)",
    "prose_wrap80": f"with recursive {_JOINED}, bodies as (select doc_id, para_no, para as body from paras), {_stepped('bodies', 'doc_id, para_no', 80, False)}, done as ({_rebuilt('select * from filled')}) select d.doc_id, formatted from documents d left join done using (doc_id)",
    "prose_wrap40": f"with recursive {_JOINED}, bodies as (select doc_id, para_no, para as body from paras), {_stepped('bodies', 'doc_id, para_no', 40, False)}, done as ({_rebuilt('select * from filled')}) select d.doc_id, formatted from documents d left join done using (doc_id)",
    "prose_sentence_mw80": f"with recursive {_JOINED}, {_SENTENCES}, bodies as (select doc_id, para_no, nth, sentence as body from sentences), {_stepped('bodies', 'doc_id, para_no, nth', 80, True)}, done as ({_rebuilt('select doc_id, para_no, string_agg(body, chr(10) order by nth) as body from filled group by all')}) select d.doc_id, formatted from documents d left join done using (doc_id)",
    "prose_needs_format": f"with {_SENTENCE_MODE} select d.lang, count(*) as n_docs, count(done.doc_id) as n_plain, coalesce(sum((formatted <> d.text)::int), 0)::bigint as n_changed from documents d left join done using (doc_id) group by d.lang",
    "abbrev_suppressed": f"with t as (select unnest(regexp_split_to_array(lower(text), '[ \\n]+')) as token from documents) select a.token, count(t.token) as n from (select unnest([{_ABBR}]) as token) a left join t using (token) group by a.token",
    "clause_breaks": f"select doc_id, {_COUNT(r'[,;][ \t\r]+')} - {_COUNT(r'&#?[A-Za-z0-9]+;[ \t\r]+')} as n_breaks from documents",
    "regex_nobreak_spans": " union all ".join(f"select '{t}' as table_name, {k} as id, " + ", ".join(f"{_COUNT(p, c)} as {n}" for n, p in _SPANS.items()) + f" from {t}" for t, k, c in (("documents", "doc_id", "text"), ("events", "event_id", "props"))),
    "line_triggers": "with t as (select doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) as token from documents) select doc_id, " + ", ".join(f"sum(regexp_matches(token, {_q(p)})::int)::bigint as {n}" for n, p in _TRIGGERS.items()) + " from t group by doc_id",
    "front_matter_end": """with t as (select doc_id, false as framed, text as t from documents union all select doc_id, true, '---' || chr(10) || text || chr(10) || '---' || chr(10) || 'rest' from documents),
      l as (select doc_id, framed, string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)) as s from t)
      select doc_id, framed, case when s[1] = '---' and list_contains(s[2:], '---') then list_position(s[2:], '---') + 1 else 0 end::bigint as n_lines from l""",
    "dialect_rule_hits": "with r(rule, pattern, kind) as (values " + ", ".join(f"({_q(n)}, {_q(p)}, {_q(k)})" for n, p, k, _ in R.DIALECT_RULES) + ") select rule, kind, count(*) as n from events join r on regexp_matches(trim(props), pattern) group by all",
    "explain_events": f"""with w(reason, detail, remediation) as (values {_CODES}), e as (select event_id, case when regexp_matches(trim(props), {_q(R.DIALECT_RULES[4][1])}) then 'dialect-block' when regexp_matches(props, {_q(_CONTROL)}) then 'control-bytes' end as reason from events)
      select event_id, 1::bigint as start_line, 1::bigint as end_line, reason, detail, remediation from e join w using (reason)""",
    "explain_reasons": f"""with w(reason, detail, remediation) as (values {_CODES}), f(case_no, start_line, end_line, reason) as (values {", ".join(f"({i}::bigint, {a}::bigint, {b}::bigint, {_q(r)})" for i, (_, _, a, b, r) in enumerate(_FROZEN) if r)})
      select conv_id, turn::bigint as turn, case_no, start_line, end_line, reason, detail, remediation from conversations cross join f join w using (reason)""",
    "text_guards": " union all ".join(f"select '{t}' as table_name, count(*) as n, sum(regexp_matches({c}, {_q(_CONTROL)})::int)::bigint as n_control, count({c}) as n_valid from {t}" for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"))),
    "render_normalize": "select page_id, regexp_replace(replace(regexp_replace(regexp_replace(html, '[\\t\\n\\f\\r ]+', ' ', 'g'), '(?i)<br *\\/?>', '<br>', 'g'), ' <br>', '<br>'), '^ | $', '', 'g') as html from pages",
    "input_refusal": f"select page_id, case when {_EXT} in ({', '.join(map(_q, R.MARKDOWN))}) then 'markdown' when {_EXT} in ({', '.join(map(_q, R.REFUSED))}) then 'refused' else 'unknown' end as verdict from pages",
    "prose_exit_code_by_source": f"""with {_SENTENCE_MODE}, c as (select d.source, d.text is null as usage, regexp_matches(d.text, {_q(_CONTROL)}) as refused, coalesce(done.formatted <> d.text, false) as changed from documents d left join done using (doc_id))
      select source, case when bool_or(usage) then 2 when bool_or(refused) then 3 when bool_or(changed) then 1 else 0 end::bigint as code from c group by source""",
    "canonical_width": "select doc_id, length(regexp_replace(text, '[ \\t\\r]+', ' ', 'g'))::bigint as width from documents",
}
