"""DuckDB SQL for those queries that SQL can express.

I-Match, packing, BPE, HTML extraction, the classifier and the randomness battery have none; tests
hold them against brute force.
"""

from __future__ import annotations

from tidegauge.llm import chat_format, decontaminate, prefix_trie, spelling, topk_search, url_filter


def _chat() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, '{chat_format.ESCAPE}', '{chat_format.ESCAPE}0')"
        for i, control in enumerate(chat_format.CONTROLS):
            out = f"replace({out}, '{control}', '{chat_format.ESCAPE}{i + 1}')"
        return out

    marks = len("<|turn|><|body|><|end|>")
    return f"""
    with said as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
      cast(sum({marks} + length({escaped("role")}) + length({escaped("text")})) as bigint) as formatted_chars, cast(0 as bigint) as n_rewrites
    from said group by conv_id
    """


def _top_k() -> str:
    return f"""
    with fit as (
      select vec_id, list_transform(embedding, lambda x: cast(floor({topk_search.SCALE} * cast(x as double)) as bigint)) as v
      from embeddings
      where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (
      select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) as bigint) as score
      from fit q join fit d on q.vec_id % {topk_search.EVERY} = 0 and d.vec_id <> q.vec_id and len(q.v) = len(d.v))
    select query_id, cast(rank as integer) as rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
    where rank <= {topk_search.K}
    """


def _near_duplicates() -> str:
    # components by repeated minima: a document takes the smallest label among itself and its links
    return r"""
    with recursive words as (
      select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
      from documents),
    shingled as (
      select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
      from words),
    items as (select doc_id, unnest(s) as item from shingled),
    common as (
      select a.doc_id as x, b.doc_id as y, count(*) as shared
      from items a join items b on a.item = b.item and a.doc_id <> b.doc_id group by 1, 2),
    links as (
      select x, y from common join shingled p on p.doc_id = x join shingled q on q.doc_id = y
      where 100 * shared >= 75 * (len(p.s) + len(q.s) - shared)),
    reached as (
      select doc_id, doc_id as other from shingled
      union
      select r.doc_id, l.y from reached r join links l on l.x = r.other)
    select d.doc_id, cast(len(s) as bigint) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
    from shingled d join (select doc_id, min(other) as component_id from reached group by 1) c on c.doc_id = d.doc_id
    """


def _urls() -> str:
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = [(rule, *rule.partition("/")[::2]) for rule, _ in ordered]
    rule = "case " + " ".join([f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{start}') then '{rule}'" for rule, name, start in fits]) + " end"
    said = "case rule " + " ".join([f"when '{rule}' then '{verdict}'" for rule, verdict in url_filter.RULES]) + " end"
    link = url_filter.LINK.replace("'", "''")
    damping, steps = url_filter.DAMPING, []
    for i in range(1, url_filter.STEPS + 1):
        steps.append(f"""
    mass{i} as materialized (
      select host, sum(trust) as trust, sum(distrust) as distrust from (
        select host, trust * {1 - damping} as trust, distrust * {1 - damping} as distrust from mass0
        union all select m.dst, p.trust * {damping} * m.t, p.distrust * {damping} * m.d from mass{i - 1} p join moves m on m.src = p.host)
      group by host)""")
    return f"""
    with cut as (select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    named as (
      select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
      from cut),
    ruled as (select page_id, host, path, {rule} as rule from named),
    judged as (select *, {said} as said from ruled),
    seeds as (
      select host, cast(count(*) filter (said = 'allow') as double) as trust, cast(count(*) filter (said = 'block') as double) as distrust
      from judged where host <> '' and said is not null group by host),
    links as (
      select host as src, translate(unnest(regexp_extract_all(html, '{link}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst
      from named where host <> ''),
    edges as (select src, dst, cast(count(*) as double) as n from links where src <> dst group by 1, 2),
    moves as materialized (
      select src, dst, n / sum(n) over (partition by src) as t, 0.0 as d from edges
      union all select dst, src, 0.0, n / sum(n) over (partition by dst) from edges),
    mass0 as materialized (
      select host, coalesce(trust / nullif(sum(trust) over (), 0), 0) as trust, coalesce(distrust / nullif(sum(distrust) over (), 0), 0) as distrust from seeds),
    {",".join(steps)},
    standing as (
      select host, coalesce(trust / nullif(sum(trust) over (), 0), 0) as trust, coalesce(distrust / nullif(sum(distrust) over (), 0), 0) as distrust from mass{url_filter.STEPS})
    select page_id, j.host, path, rule,
      coalesce(said, case when round(coalesce(distrust / nullif(trust + distrust, 0), 0), 9) > {url_filter.THRESHOLD} then 'block' else 'allow' end) as verdict
    from judged j left join standing s on s.host = j.host
    """


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a string of code points below U+0800, byte by byte."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    coded = f"flatten(list_transform(string_split({text}, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)] else [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] end))"
    return f"xor(list_reduce(list_transform({coded}, lambda b: cast(b as bigint)), lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1]), cast(4294967295 as bigint)), 4294967295)"


def _spelling() -> str:
    folded = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    with recursive runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
    counted as (select doc_id, {folded} as run, count(*) as times from runs group by 1, 2),
    hashed as (select run, times, {_crc32("concat(doc_id, ':', run)")} as h from counted where length(run) >= {spelling.LETTERS}),
    misspelt as (
      select case when h % {spelling.MISSPELT_EVERY} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from hashed),
    words as materialized (
      select word, cast(sum(times) as bigint) as n from misspelt where length(word) >= {spelling.LETTERS} group by 1 having sum(times) >= {spelling.OCCURRENCES}),
    cut as (
      select word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: {{'at': i, 'rest': substr(word, 1, i - 1) || substr(word, i + 1)}}), recursive := true) from words),
    shorter as (select distinct c.word as a, c.n as a_n, w.word as b, w.n as b_n from cut c join words w on w.word = c.rest),
    near as (
      select x.word as a, x.n as a_n, y.word as b, y.n as b_n from cut x join cut y on x.rest = y.rest and x."at" = y."at" and x.word <> y.word
      union all select a, a_n, b, b_n from shorter
      union all select b, b_n, a, a_n from shorter),
    stood as (
      select w.word, w.n, count(x.b) as n_near, first(x.b order by x.b_n desc, x.b) as best, first(x.b_n order by x.b_n desc, x.b) as best_n
      from words w left join near x on x.a = w.word group by 1, 2),
    formed as materialized (
      select word, n, n_near, case when best_n >= {spelling.FORM_TIMES} * n then best end as form, case when best_n >= {spelling.FORM_TIMES} * n then best_n end as form_n from stood),
    chain as (
      select word, word as at_word, form from formed
      union all select c.word, f.word, f.form from chain c join formed f on f.word = c.form)
    select f.word, f.form, c.at_word as root, f.n, f.n_near, f.form_n from formed f join chain c on c.word = f.word and c.form is null
    """


def _contamination() -> str:
    span = decontaminate.SPAN

    def worded(name: str, key: str) -> str:
        lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"select {key}, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {name}"

    def cut(length: str, key: str) -> str:
        return f"select {key}, unnest(list_transform(range(1, len(w) - {length} + 2), lambda i: {{'at': i, 'span': {length}, 'words': array_to_string(w[i:i + {length} - 1], ' ')}}), recursive := true)"

    return f"""
    with docs as ({worded("(select row_number() over () as row, doc_id, text from documents)", "row, doc_id")}),
    items as ({worded("benchmark", "item_id")}),
    held as materialized (
      select distinct item_id, span, words from ({cut(f"least({span}, len(w))", "item_id")} from items where len(w) > 0)),
    spans as (select distinct span as n from held),
    met as (
      select d.row, d."at", d.span, d.words from ({cut("n", "row")} from docs, spans where len(w) >= n) d
      where (d.span, d.words) in (select span, words from held)),
    inside as (select row, count(*) as n_hit from (select distinct row, unnest(range("at", "at" + span)) as word from met) group by 1),
    listed as (
      select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
      from (select distinct m.row, cast(h.item_id as varchar) as item_id from met m join held h on h.span = m.span and h.words = m.words where h.item_id is not null) group by 1)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
      coalesce(n_hit, 0) > 0 as contaminated
    from docs left join inside using (row) left join listed using (row)
    """


def _trie() -> str:
    shared, family = prefix_trie.SHARED, prefix_trie.FAMILY
    return f"""
    with said as (
      select conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, strlen(coalesce(text, '')) as n_bytes
      from conversations where conv_id is not null),
    ranked as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as rank from said),
    convs as (
      select conv_id, count(*) as n, {_crc32("cast(conv_id as varchar)")} % {shared} as h, conv_id - conv_id % {family} as base_id from said group by conv_id),
    turns as (
      select c.conv_id, r.rank as pos, r.digest, r.n_bytes from convs c join ranked r on r.conv_id = c.base_id and r.rank <= c.h
      union all
      select c.conv_id, r.rank - c.h + least(c.h, coalesce(b.n, 0)), r.digest, r.n_bytes
      from convs c join ranked r on r.conv_id = c.conv_id and r.rank > c.h left join convs b on b.conv_id = c.base_id),
    members as materialized (
      select conv_id, pos as depth, md5(string_agg(digest, ',') over (partition by conv_id order by pos)) as id, n_bytes from turns
      union all select conv_id, 0, 'root', 0 from convs),
    last as (select conv_id, max(depth) as depth from members group by conv_id),
    nodes as materialized (select id, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(n_bytes) as n_bytes from members group by id, depth),
    above as (
      select n.id, n.depth, m.id as parent from nodes n join members m on m.conv_id = n.conv_id and m.depth = n.depth - 1),
    kids as (select parent as id, count(*) as n_children from above group by 1),
    totals as (
      select m.id, m.depth, count(*) filter (k.id is null) as n_leaves, sum((n.n_convs - 1) * n.n_bytes) as saved_tokens
      from nodes n left join kids k on k.id = n.id join members m on m.conv_id = n.conv_id and m.depth <= n.depth group by 1, 2),
    ends as (select m.id, string_agg(m.conv_id, ',' order by m.conv_id) as ids from members m join last l on l.conv_id = m.conv_id and l.depth = m.depth group by 1)
    select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, t.n_leaves,
      cast(t.saved_tokens as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
    from nodes n left join above a on a.id = n.id left join nodes p on p.id = a.parent left join kids k on k.id = n.id
      join totals t on t.id = n.id left join ends e on e.id = n.id
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": _chat(),
        "op2_exact_top_k": _top_k(),
        "op5_url_filter": _urls(),
        "op6_minhash_near_dedup": _near_duplicates(),
        "op11_spelling_variants": _spelling(),
        "op12_benchmark_decontamination": _contamination(),
        "op13_prefix_trie": _trie(),
    }
