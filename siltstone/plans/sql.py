"""The SQL that DuckDB runs beside the queries: named common table expressions and one final select for each query."""

from __future__ import annotations

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WORD = r"[^\p{L}\p{N}_]+"
PATH = r"'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)'"
ORIGIN = r"'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)'"
AUTHORITY = r"'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{NON_WORD}'), lambda t: t <> '')"


def normalized(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{NON_WORD}', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({normalized(x)}, ' '), lambda w: w <> '')"


def key(x: str) -> str:
    return f"array_to_string(list_sort(({words(x)})[1:6]), ' ')"


def title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '(\p{{L}}+|[^\p{{L}}]+)'), lambda r: upper(r[1:1]) || lower(r[2:])), '')"


def first_sentence(x: str) -> str:
    return strip(rf"regexp_extract({x}, '^([^.!?\n]*[.!?]?)', 1)")


def file_name(x: str) -> str:
    return f"replace(regexp_replace(regexp_extract({x}, {PATH}, 1), '^/+|/+$', '', 'g'), '/', '_') || '.html'"


def embedding(x: str) -> str:
    # One row for each token and place, then the counts as a list.
    place = "('0x' || substr(md5(t), 1, 4))::int % 64"
    return f"""(select case when sqrt(list_sum(list_transform(c, lambda v: v * v))) > 0 then list_transform(c, lambda v: v / sqrt(list_sum(list_transform(c, lambda u: u * u)))) else c end
      from (select list_transform(range(64), lambda d: len(list_filter(p, lambda q: q = d))::double) as c from (select list_transform({tokens(f"coalesce({x}, '')")}, lambda t: {place}) as p)))"""


def f1(g: str, p: str) -> str:
    a, b = f"list_distinct({words(g)})", f"list_distinct({words(p)})"
    return f"case when len({a}) + len({b}) > 0 then 2.0::double * len(list_intersect({a}, {b})) / (len({a}) + len({b})) else 0.0 end"


def accepts(g: str, p: str) -> str:
    return f"((contains({normalized(g)}, 'don t know') and contains({normalized(p)}, 'don t know')) or {f1(g, p)} >= 0.5)"


def metric(g: str, p: str) -> str:
    return f"case when {p} is null or {strip(p)} = '' then 0.0::double else coalesce(({accepts(g, p)})::int::double, 0.0) end"


def answer_of(x: str) -> str:
    return first_sentence(rf"regexp_replace({x}, '^\[[^\]]*\] (\.\.\. )?', '')")


def question_of(section: str, x: str) -> str:
    return f"'What does ' || {section} || ' say about ' || coalesce(list_sort(list_transform({tokens(x)}, lambda t: {{'n': -length(t), 't': t}}))[1].t, 'it') || '?'"


def bm25(prefix: str, queries: str, docs: str, k: int) -> dict[str, tuple[str, str]]:
    """Common table expressions that end in ``{prefix}bm25``; queries: query_id, text; docs: chunk_id, text."""
    p = prefix
    return {
        f"{p}tk": (docs, f"select chunk_id, {tokens('text')} as tk from {docs}"),
        f"{p}dt": (f"{p}tk", f"select chunk_id, len(tk) as dl, unnest(tk) as term from {p}tk"),
        f"{p}post": (f"{p}dt", f"select chunk_id, term, dl, count(*) as tf from {p}dt group by all"),
        f"{p}stats": (f"{p}tk", f"select count(*) as n, avg(len(tk)) as avgdl from {p}tk where tk is not null"),
        f"{p}qt": (queries, f"select query_id, unnest(list_distinct({tokens('text')})) as term from {queries}"),
        f"{p}idf": (f"{p}post {p}stats", f"select term, count(*) as df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from {p}post, {p}stats group by term"),
        f"{p}bscore": (f"{p}post {p}stats {p}qt {p}idf", f"select query_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from {p}post join {p}qt using (term) join {p}idf using (term), {p}stats group by all"),
        f"{p}bm25": (f"{p}bscore", f"select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {p}bscore qualify rank <= {k}"),
    }


def hybrid(prefix: str, queries: str, docs: str, k: int) -> dict[str, tuple[str, str]]:
    """``{prefix}vec``, ``{prefix}fused`` (all) and ``{prefix}top`` (reranked) beside those of :func:`bm25`."""
    p = prefix
    return bm25(p, queries, docs, 2 * k) | {
        f"{p}de": (docs, f"select chunk_id, {embedding('text')} as v from {docs}"),
        f"{p}qe": (queries, f"select query_id, {embedding('text')} as v from {queries}"),
        f"{p}vscore": (f"{p}de {p}qe", f"select query_id, chunk_id, list_inner_product({p}de.v, {p}qe.v) as score from {p}de, {p}qe"),
        f"{p}vec": (f"{p}vscore", f"select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {p}vscore qualify rank <= {2 * k}"),
        f"{p}rr": (f"{p}vec {p}bm25", f"select query_id, chunk_id, sum(1.0::double / (60 + rank - 1)) as score from (select query_id, chunk_id, rank from {p}vec union all select query_id, chunk_id, rank from {p}bm25) group by all"),
        f"{p}fused": (f"{p}rr", f"select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {p}rr qualify rank <= {3 * k}"),
        f"{p}rs": (f"{p}fused {p}tk {queries} {docs}", f"select query_id, chunk_id, d.text, len(list_intersect(q.qk, x.tk))::double / greatest(len(q.qk), 1) as score from {p}fused join (select query_id, list_distinct({tokens('text')}) as qk from {queries}) q using (query_id) join {p}tk x using (chunk_id) join {docs} d using (chunk_id)"),
        f"{p}top": (f"{p}rs", f"select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {p}rs qualify rank <= {k}"),
    }


_CHUNK = "STRUCT(sec VARCHAR, cur VARCHAR, res STRUCT(t VARCHAR, s VARCHAR)[])"
_OPENED = "(case when acc.cur = '' then '[' || acc.sec || '] ' else acc.cur end || blk_.text || ' ')"


def fold(blocks: str) -> str:
    """Chunks of a list of (tag, text) by the sequential rule."""
    emit = lambda text, section: f"list_append(acc.res, {{'t': trim({text}), 's': {section}}})"
    start = f"{{'sec': 'General', 'cur': '', 'res': []}}::{_CHUNK}"
    step = f"""case when blk_.tag[1:1] = 'h' then {{'sec': blk_.text, 'cur': '', 'res': case when acc.cur <> '' then {emit('acc.cur', 'blk_.text')} else acc.res end}}::{_CHUNK}
      when length({_OPENED}) > 800 then {{'sec': acc.sec, 'cur': '[' || acc.sec || '] ... ' || right({_OPENED}, 150), 'res': {emit(_OPENED, 'acc.sec')}}}::{_CHUNK}
      else {{'sec': acc.sec, 'cur': {_OPENED}, 'res': acc.res}}::{_CHUNK} end"""
    return f"list_reduce({blocks}, lambda acc, blk_: {step}, {start})"


CTES: dict[str, tuple[str, str]] = {
    # Pages: the markup of these tables is regular, so the main content can be cut by patterns and blocks by depth.
    "cut": ("", "select page_id, url, regexp_extract(regexp_replace(html, '(?s)<nav.*?</nav>|<script.*?</script>|<style.*?</style>|<footer.*?</footer>|<!--.*?-->', '', 'g'), '(?s)<article>(.*?)</article>', 1) as body from pages"),
    "tok": ("cut", "select page_id, unnest(regexp_extract_all(body, '<[^>]+>|[^<]+')) as tok, generate_subscripts(regexp_extract_all(body, '<[^>]+>|[^<]+'), 1) as i from cut"),
    "dep": ("tok", "select *, " + ", ".join(f"sum(case when tok = '<{t}>' then 1 when tok = '</{t}>' then -1 else 0 end) over (partition by page_id order by i) as {t}" for t in ("p", "h1", "li")) + " from tok"),
    "opener": ("dep", "select page_id, i, tok[2:-2] as tag, case tok when '<p>' then p when '<h1>' then h1 else li end as depth from dep where tok in ('<p>', '<h1>', '<li>')"),
    "span": ("opener dep", "select o.page_id, o.i, o.tag, coalesce(min(d.i), 1000000000) as j from opener o left join dep d on d.page_id = o.page_id and d.i > o.i and case o.tag when 'p' then d.p when 'h1' then d.h1 else d.li end < o.depth group by all"),
    "txt": ("tok", f"select page_id, i, {strip('''replace(replace(replace(replace(tok, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')''')} as t from tok where tok[1:1] <> '<'"),
    "blk": ("span txt", "select s.page_id, s.i, s.tag, string_agg(t, ' ' order by x.i) as text, string_agg(t, '' order by x.i) as plain from span s join txt x on x.page_id = s.page_id and x.i > s.i and x.i < s.j where t <> '' group by all"),
    "blocks": ("blk", "select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, tag, text, plain from blk"),
    "bl": ("blocks", "select page_id, list({'tag': tag, 'text': text, 'plain': plain} order by pos) as b from blocks group by page_id"),
    "folded": ("bl", f"select page_id, {fold('b')} as f from bl"),
    "ck": ("folded", "select page_id, unnest(case when f.cur <> '' then list_append(f.res, {'t': trim(f.cur), 's': f.sec}) else f.res end) as c, generate_subscripts(case when f.cur <> '' then list_append(f.res, {'t': trim(f.cur), 's': f.sec}) else f.res end, 1) - 1 as ordinal from folded"),
    "page_chunks": ("ck", "select page_id, ordinal::int as ordinal, c.s as section, c.t as text from ck"),
    "names": ("", f"select {file_name('url')} as name, max(page_id) as page_id, count(*) as n_pages from pages group by 1"),
    "corpus": ("names page_chunks", "select replace(regexp_replace(name, '\\.html$', ''), '-', '_') || '_' || ordinal as chunk_id, replace(regexp_replace(name, '\\.html$', ''), '-', '_') as doc_id, 'Knowledge Base' as source, 'data/raw/' || name as source_path, section, text, ordinal from names join page_chunks using (page_id)"),
    "hrefs": ("", """select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href, (generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1)::int as pos from pages"""),
    "targets": ("hrefs", f"select page_id, url, pos, regexp_replace(regexp_extract(url, {ORIGIN}, 1) || href, '#.*', '') as target from hrefs"),
    # Question and answer pairs: a user's turn and the assistant's after it.
    "turns": ("", "select *, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn)"),
    "pairs": ("turns", "select conv_id * 1000 + turn as pos, 'topic_' || (conv_id % 13) as doc_id, case when conv_id % 3 = 0 then 'General' else 'Section ' || (conv_id % 7) end as section, text as question, next_text as answer, text || chr(10) || next_text as context from turns where role = 'user' and next_role = 'assistant'"),
    "topics": ("pairs", f"select *, case when section is null or section in ('', 'General') then {title('''replace(coalesce(doc_id, 'General'), '_', ' ')''')} else section end as inferred_topic, {key('question')} as similarity_key from pairs where length({strip('question')}) > 10 and length({strip('answer')}) > 10"),
    "counts": ("topics", "select inferred_topic, count(*) as n, min(pos) as first_pos from topics group by 1"),
    "rare": ("counts", "select inferred_topic, n, row_number() over (order by n, first_pos) as place from counts qualify place <= (select count(*) // 2 from counts)"),
    "grp": ("topics rare", "select similarity_key, count(*) as n, bool_or(inferred_topic in (select inferred_topic from rare)) as rare, md5('42' || similarity_key) as o from topics group by 1"),
    "d1": ("grp", "select *, coalesce(sum(n) over (order by o, similarity_key rows between unbounded preceding and 1 preceding), 0) as b from grp where rare"),
    "t1": ("d1", "select similarity_key, n, rare, o, coalesce(sum(n) over (order by o, similarity_key rows between unbounded preceding and 1 preceding), 0) as b from d1 where b >= 30"),
    "r2": ("grp d1 t1", "select * from grp where not rare union all select similarity_key, n, rare, o from t1 where b >= 30"),
    "a2": ("r2", "select *, coalesce(sum(n) over (order by o, similarity_key rows between unbounded preceding and 1 preceding), 0) as b from r2"),
    "d2": ("a2 d1", "select similarity_key, n, rare, o, (select coalesce(sum(n), 0) from d1 where b < 30) + coalesce(sum(n) over (order by o, similarity_key rows between unbounded preceding and 1 preceding), 0) as b from a2 where b >= 40"),
    "t2": ("d2 t1", "select similarity_key, n, rare, o, (select coalesce(sum(n), 0) from t1 where b < 30) + coalesce(sum(n) over (order by o, similarity_key rows between unbounded preceding and 1 preceding), 0) as b from d2 where b >= 30"),
    "assigned": ("d1 t1 a2 d2 t2", "select similarity_key, n, 'dev' as split, 1 as turn, o from d1 where b < 30 union all select similarity_key, n, 'test', 1, o from t1 where b < 30 union all select similarity_key, n, 'train', 2, o from a2 where b < 40 union all select similarity_key, n, 'dev', 2, o from d2 where b < 30 union all select similarity_key, n, 'test', 2, o from t2 where b < 30"),
    "splits": ("topics assigned", "select topics.*, split, row_number() over (partition by split order by turn, o, similarity_key, pos) as place from topics join assigned using (similarity_key) qualify place <= case split when 'train' then 40 else 30 end"),
    # Retrieval: benchmark items asked of the documents.
    "docs": ("", "select doc_id as chunk_id, text from documents"),
    "items": ("", "select item_id as query_id, text from benchmark"),
    "q_multi": ("", f"""select item_id, unnest(e) as text, generate_subscripts(e, 1) - 1 as query_pos from (select item_id, list_concat([text],
      list_filter(list_transform([array_to_string({'{d}'}, ' '), array_to_string(list_sort({'{d}'}), ' ')], lambda x: {strip('x')}), lambda x: x <> '')[1:2], ['It is about ' || array_to_string({'{d}'}, ', ') || '.']) as e from
      (select item_id, text, {'{u}'} as u from benchmark))"""),
}
# Different tokens in the order in which they first appear.
_UNIQUE = f"list_filter({tokens('text')}, lambda t, i: list_position({tokens('text')}, t) = i)"
CTES["q_multi"] = ("", CTES["q_multi"][1].replace("{d}", "u").replace("{u}", _UNIQUE))
CTES |= hybrid("", "items", "docs", 3)
# The same among the documents of one language: the lists are cut after the condition.
for _list, _score in (("f_vec", "vscore"), ("f_bm25", "bscore")):
    CTES[_list] = (_score, f"select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {_score} where chunk_id in (select doc_id from documents where lang = 'de') qualify rank <= 6")
CTES["f_rr"] = ("f_vec f_bm25", "select query_id, chunk_id, sum(1.0::double / (60 + rank - 1)) as score from (select query_id, chunk_id, rank from f_vec union all select query_id, chunk_id, rank from f_bm25) group by all")
CTES["f_fused"] = ("f_rr", "select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from f_rr qualify rank <= 9")
CTES["mq"] = ("q_multi", "select item_id || ':' || query_pos as query_id, item_id, query_pos, text from q_multi")
CTES |= hybrid("m_", "mq", "docs", 3)
CTES["m_found"] = ("m_top mq", "select mq.item_id as question_id, mq.query_pos, m_top.rank, m_top.chunk_id, m_top.text, m_top.score from m_top join mq using (query_id)")
CTES["ctx0"] = ("m_found", "select * from m_found qualify row_number() over (partition by question_id, text order by query_pos, rank) = 1")
CTES["ctx"] = ("ctx0", "select question_id, row_number() over (partition by question_id order by query_pos, rank) as pos, chunk_id, text from ctx0")
CTES["asked"] = ("ctx", f"select b.item_id as question_id, b.text as question, case when coalesce({first_sentence('c.text')}, '') <> '' then {first_sentence('c.text')} else 'I don''t know.' end as answer, (select count(*) from ctx x where x.question_id = b.item_id) as n_context from benchmark b left join ctx c on c.question_id = b.item_id and c.pos = 1")
# Two programs answer the pairs of the splits: one repeats the answer's first sentence, one the question.
CTES["preds"] = ("splits", f"select split, pos, question, answer, 'initial' as run, question as predicted from splits union all select split, pos, question, answer, 'final', {first_sentence('answer')} from splits")
CTES["scored"] = ("preds", f"select *, {metric('answer', 'predicted')} as metric from preds")
CTES["runs"] = ("scored", "select run, split, sum(metric) as total, count(*) as n, round(100 * avg(metric), 1) as percent from scored group by all")
CTES["cands"] = ("", "select * from (values (0, 'question'), (1, 'sentence'), (2, 'answer'), (3, 'unknown')) t(candidate, program)")
CTES["trials"] = ("cands splits", f"select candidate, trial, pos, {metric('answer', 'predicted')} as metric from (select candidate, trial, pos, answer, case program when 'question' then question when 'sentence' then {first_sentence('answer')} when 'answer' then answer else 'I don''t know.' end as predicted from cands, range(5) r(trial), splits where split = 'train' qualify row_number() over (partition by candidate, trial order by md5(trial || '|' || pos), pos) <= 4)")
# Instructions and demonstration sets, halved twice; what isn't tried again keeps its last score.
CTES["boot"] = ("scored", "select * from (select run, pos, question, answer, row_number() over (partition by run order by pos) as place from scored where split = 'train' and metric = 1) where place <= 1")
CTES["sets"] = ("boot", "select 0 as set_no, null as dq, null as da union all select row_number() over (order by run), question, answer from boot")
CTES["progs"] = ("sets cands", "select candidate * 1000 + set_no as candidate, program, (set_no > 0)::int as n_demos, dq, da from cands, sets")
CTES["pool"] = ("splits boot", "select pos, question, answer from splits where split = 'train' and pos not in (select pos from boot)")
for _r, _of in enumerate(("progs", "k0", "k1")):
    _own = f"case program when 'question' then question when 'sentence' then {first_sentence('answer')} when 'answer' then answer else 'I don''t know.' end"
    CTES[f"b{_r}"] = ("pool", f"select * from pool qualify row_number() over (order by md5('{_r}|' || pos), pos) <= {4 * 2**_r}")
    CTES[f"p{_r}"] = (f"b{_r} {_of}", f"select candidate, answer, case when dq is not null and {f1('question', 'dq')} >= 0.5 then da else {_own} end as predicted from b{_r}, {_of}")
    CTES[f"s{_r}"] = (f"p{_r}", f"select candidate, {_r} as rung, round(avg({metric('answer', 'predicted')}), 6) as score from p{_r} group by candidate")
    CTES[f"k{_r}"] = (f"s{_r} progs", f"select progs.* from progs join (select candidate from s{_r} order by score desc, candidate limit (select greatest(1, round((select count(*) from {_of}) * 0.5)))) using (candidate)")
CTES["rungs"] = ("s0 s1 s2", "select * from (select * from s0 union all select * from s1 union all select * from s2) qualify row_number() over (partition by candidate order by rung desc) = 1")


def sql(final: str, *names: str) -> str:
    """``final`` after the common table expressions it names and all that these need."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in CTES and name not in order:
            for x in CTES[name][0].split():
                need(x)
            order.append(name)

    for name in names:
        need(name)
    return ("with " + ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order) + "\n" if order else "") + final
