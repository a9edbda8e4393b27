"""DuckDB SQL that says what the registered queries must return. Its patterns and lists are written out here, not the engine's."""

from __future__ import annotations

# --- fixed values, for DuckDB's patterns ---
AT_START = r"(?i)^Item[\s\x{A0}]*([0-9]{1,2}[A-C]?)\b"
ENDERS = {"1": "'1A', '1B', '2'", "1A": "'1B', '2'", "7": "'7A', '8'", "7A": "'8'"}
CONTENTS = r"(?i)\bTable of Contents\b"
CROSS_REFERENCE = r"(?i)\b(see|refer to|as discussed in)\b|(of|in)\s+Part\s+[IVXLC]+\b"
RELATING = r"(?i)\b(relating to|related to|with respect to)\b"
ANCHORS = {
    "1": (r"\bBusiness\b", r"\bOverview\b"),
    "1A": ("Risk Factors", "material risks", "could adversely affect"),
    "7": ("Management.?s Discussion", "Results of Operations", "Liquidity and Capital Resources", "Critical Accounting"),
    "7A": ("Quantitative and Qualitative", "Market Risk", "Interest Rate Risk", "Foreign Currency", "Commodity Price"),
}
GOOD_TERMS = (r"(?i)\bFORM\s*10[-\s]*K\b", r"(?i)\bANNUAL\s+REPORT\b")
BAD_NAME_HINTS = ("index", "cover", "toc", "table", "summary", "xbrl", "xml", "exhibit", "wrap", "presentation", "press")
NO_BRANDS = ("United States", "U.S.", "US", "USA", "SEC", "GAAP", "IFRS", "FASB", "OECD", "NYSE", "NASDAQ", "S&P", "Moody''s", "Fitch", "COVID-19", "LIBOR", "SOFR")
POSITIVE = "gain gains growth improved increase increased profit strong favorable expanded accelerated stable robust recovered"
NEGATIVE = "loss losses decline decreased impaired risk adverse weak delayed dispute abrupt volatile contested curtailed"
NEVER_ENDS = r"Mr|Mrs|Ms|Messrs|Dr|Prof|Rev|Hon|Gen|Sen|Rep|Gov|St|vs|cf|approx|e\.g|i\.e|et al|Reg|Ref|Ex|Vol|pp"
BEFORE_FIGURES = r"No|Nos|Note|Item|Art|Sec|Fig|Figs|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
MAY_END = r"Inc|Corp|Co|Ltd|LLC|Jr|Sr|U\.S|U\.K|U\.S\.A|etc"
OPENERS = r"The|A|An|We|Our|It|Its|This|These|That|They|Their|He|She|In|On|At|As|For|If|When|While|However|There|No|All|Each|Such|Any"

#: White space as in Unicode.
WS = r"[\s\x{0B}\x{85}\p{Z}]"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def ticker(c: str = "ticker") -> str:
    return f"upper({trim(c)})"


def _case(c: str, kinds: dict[str, str]) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in kinds.items()) + " end"


HEADS = {"1": "'Item 1. Business'", "1A": "'Item 1A. Risk Factors'", "7": "'Item 7. Results of Operations'", "7A": "'Item 7A. Market Risk'"}
LEAST = {"1": "300", "1A": "300", "7": "300", "7A": "200"}

FILINGS = f"""
with f as (select accession, string_agg({_case('item', HEADS)} || chr(10) || text, chr(10) || chr(10) order by item, doc_id) as text
           from documents where text is not null and accession is not null group by accession),
p as (select accession, text, string_split(regexp_replace(text, '(?i)(\\bItem[\\s\\x{{A0}}]*[0-9])', chr(1) || '\\1', 'g'), chr(1)) as parts from f),
i as (select accession, text, parts, unnest(range(1, len(parts))) as i from p),
m0 as (select accession, text, list_sum(list_transform(parts[1:i], lambda x: length(x)))::bigint as pos from i),
m as (select *, upper(regexp_extract(substr(text, pos + 1), '{AT_START}', 1)) as item from m0)
"""

SCREENS = f"""
, n as (select distinct a.accession, a.pos from m a join m b on a.accession = b.accession and b.pos > a.pos and b.pos < a.pos + 400
        where regexp_matches(substr(a.text, b.pos + 1, a.pos + 400 - b.pos), '{AT_START}')),
s as (select m.*, pos < floor(length(text) * 0.05) and regexp_matches(substr(text, greatest(pos - 250, 0) + 1, pos + 250 - greatest(pos - 250, 0)), '{CONTENTS}') as toc,
      (accession, pos) in (select (accession, pos) from n) as near,
      regexp_matches(substr(text, pos + 1, 220), '{CROSS_REFERENCE}') as cross_ref,
      regexp_matches(substr(text, pos + 1, 100), '{RELATING}') as relating from m)
"""

_enders = " or ".join(f"(a.item = '{k}' and b.item in ({v}))" for k, v in ENDERS.items())
ENDS = f"""
, e as (select a.accession, a.pos, coalesce(min(b.pos) filter ({_enders}), min(b.pos) filter (b.item <> ''), any_value(length(a.text)))::bigint as ends_at
        from m a left join m b on a.accession = b.accession and b.pos > a.pos where a.item in ('1', '1A', '7', '7A') group by a.accession, a.pos)
"""

_anchors = " + ".join(f"case when item = '{k}' and regexp_matches(w, '(?i){p}') then 200 else 0 end" for k, v in ANCHORS.items() for p in v)
_anchor7 = " or ".join(f"regexp_matches(w5, '(?i){p}')" for p in ANCHORS["7"])
CANDIDATES = f"""
, k as (select s.*, e.ends_at, case when item = '7A' then not toc and not near else not toc and not near and not cross_ref and not relating end as strict
        from s join e using (accession, pos)),
k2 as (select *, bool_or(strict) over (partition by accession, item) as any_strict from k),
k3 as (select *, ends_at - pos as len, substr(text, pos + 1, least(6000, ends_at - pos)) as w, substr(text, pos + 1, least(5000, ends_at - pos)) as w5
       from k2 where case when any_strict then strict when item = '1' then not toc else false end),
c as (select accession, item as label, pos as start, ends_at, len,
      (length(w) // 50 + {_anchors}
       + case when item = '1A' and regexp_matches(substr(w, 1, 300), '(?i)\\bRisk\\s+Factors\\b') then 400 else 0 end
       + case when item = '1' and regexp_matches(substr(w, 1, 300), '(?i)\\bItem[\\s\\x{{A0}}]*1\\b[^\\n]{{0,120}}\\bBusiness\\b') then 500 else 0 end
       - case when item = '1' and not regexp_matches(substr(w, 1, 600), '(?i)\\bBusiness\\b') then 500 else 0 end
       - case when item = '1' and regexp_matches(substr(w, 1, 800), '(?i)\\bexecutive officers?\\b') then 200 else 0 end
       - case when near then 500 else 0 end - case when cross_ref then 600 else 0 end
       + case when instr(substr(text, pos + 1, 120), chr(10)) between 1 and 81 then 120 else 0 end)::bigint as score,
      case when item = '1' then regexp_matches(w5, '(?i)\\bBusiness\\b') when item = '7' then {_anchor7} else false end as anchored,
      row_number() over (partition by accession, item order by pos) as ord, text from k3)
"""

BEST = f"""
, r as (select *, row_number() over (partition by accession, label order by score desc, len desc, ord) as r1,
        row_number() over (partition by accession, label order by anchored desc, len desc, score desc, ord) as r2,
        row_number() over (partition by accession, label order by len desc, score desc, ord) as r3,
        count(*) over (partition by accession, label) as n_candidates from c),
b as (select accession, label, any_value(n_candidates) as n, max(len) filter (r1 = 1) as best_len, max(len) filter (ord = n_candidates) as last_len from r group by 1, 2),
x as (select r.accession, r.label as section, r.start, r.ends_at as "end", r.n_candidates, r.score, {trim('substr(r.text, r.start + 1, r.len)')} as text from r join b using (accession, label)
      where case when best_len >= {_case('r.label', LEAST)} or n = 1 then r1 = 1
                 when r.label in ('1', '7') then r2 = 1
                 when last_len > best_len then ord = n else r3 = 1 end)
"""

PAGES = """
with g as (select doc_id, ticker, fiscal_year, source, '<html><head><style>p { x }</style><script>var a = ''<p>'';</script></head><body><p>' || replace(text, chr(10), '</p>' || chr(10) || '<br/><p>') || '</p></body></html>' as html
           from documents where text is not null)
"""
STRIP = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?is)<[^>]+>', ' ', 'g')"
STRIPPED = trim(f"regexp_replace({STRIP}, '{WS}+', ' ', 'g')")


def _tidy(c: str) -> str:
    c = f"replace({c}, chr(13), chr(10))"
    c = rf"regexp_replace({c}, '[ \t\f\x{{0B}}]+', ' ', 'g')"
    c = rf"regexp_replace({c}, '\n[ \t\f\x{{0B}}]+', chr(10), 'g')"
    return trim(rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _lines() -> str:
    c = "html"
    for part in ("script", "style", "noscript"):
        c = f"regexp_replace({c}, '(?is)<{part}[^>]*>.*?</{part}>', '', 'g')"
    return _tidy(f"regexp_replace({c}, '(?s)<[^>]*>', chr(10), 'g')")


_good = " + ".join(f"case when regexp_matches(text, '{p}') then 10000 else 0 end" for p in GOOD_TERMS)
_bad = " + ".join(f"case when contains(lower(coalesce(source, '')), '{h}') then 3000 else 0 end" for h in BAD_NAME_HINTS)
#: RE2 has no lookahead; before a word boundary these say the same, but for 7, which may not be followed by A as a word.
_hits = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in (r"(?i)\bItem[\s\x{A0}]*1\b", r"(?i)\bItem[\s\x{A0}]*1A\b", r"(?i)\bItem[\s\x{A0}]*7", r"(?i)\bItem[\s\x{A0}]*7A\b")) + r" - len(regexp_extract_all(text, '(?i)\bItem[\s\x{A0}]*7A\b'))"

_SPACE = r"[ \t\n\r\f\x{0B}]"
_BEFORE = r"""(^|[ \t\n\r\f\x{0B}("\[])"""


def _marked(c: str) -> str:
    """c with U+0001 where a sentence ends, U+0002 and U+0003 for the full stops of abbreviations."""
    for _ in range(2):
        c = rf"regexp_replace({c}, '{_BEFORE}({NEVER_ENDS})\.({_SPACE})', '\1\2' || chr(2) || '\3', 'g')"
        c = rf"regexp_replace({c}, '{_BEFORE}({BEFORE_FIGURES})\.({_SPACE}+[0-9])', '\1\2' || chr(2) || '\3', 'g')"
        c = rf"regexp_replace({c}, '{_BEFORE}({MAY_END})\.({_SPACE})', '\1\2' || chr(3) || '\3', 'g')"
    c = rf"regexp_replace({c}, chr(3) || '({_SPACE}+)({OPENERS})([^A-Za-z0-9_]|$)', '.\1\2\3', 'g')"
    return rf"regexp_replace({c}, '([.!?]){_SPACE}+', '\1' || chr(1), 'g')"


def _sentences(c: str) -> str:
    part = trim("replace(replace(x, chr(2), '.'), chr(3), '.')")
    return f"""
with z as (select *, list_filter(list_transform(string_split({_marked(c)}, chr(1)), lambda x: {part}), lambda x: x <> '') as s from documents where text is not null),
e as (select * exclude s, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as k from z)
"""


SENTENCES = _sentences("text")
MERGED = """
, g as (select *, coalesce(sum((length(sentence) >= 25)::int) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as grp from e),
h as (select doc_id, any_value(ticker) as ticker, any_value(fiscal_year) as fiscal_year, any_value(filing_date) as filing_date, any_value(accession) as accession, any_value(item) as item, grp, string_agg(sentence, ' ' order by k) as sentence from g group by doc_id, grp),
w as (select * exclude grp, (row_number() over (partition by doc_id order by grp) - 1)::bigint as k from h)
"""


def _words(words: str) -> str:
    return f"len(list_filter(string_split_regex(lower(sentence), '[^a-z]+'), lambda x: x in ({', '.join(repr(w) for w in words.split())})))"


SCORED = SENTENCES + MERGED + f"""
, v as (select w.*, {_words(POSITIVE)} as a, {_words(NEGATIVE)} as b from w where item in ('1A', '7')),
y as (select *, a / (a + b + 2.0)::double as pos, 2.0 / (a + b + 2.0)::double as neu, b / (a + b + 2.0)::double as neg from v),
t as (select ticker, fiscal_year, filing_date, accession, item, count(*) as n_sentences, avg(pos) as p, avg(neu) as u, avg(neg) as n from y group by 1, 2, 3, 4, 5)
"""


def _micro(c: str) -> str:
    return f"floor({c} * 1e6::double + 1e-3::double)::bigint"


def _label(p: str, u: str, n: str) -> str:
    return f"case when {p} >= {u} and {p} >= {n} then 'positive' when {u} >= {n} then 'neutral' else 'negative' end"


def _tuned(source: str, p: str, u: str, n: str, keys: str) -> str:
    o = lambda c: f"pow(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6)), 1 / 0.85::double)"
    return f"select {keys}, a / (a + b + c) as p, b / (a + b + c) as u, c / (a + b + c) as n from (select {keys}, {o(p)} as a, {o(u)} as b, {o(n)} as c from {source})"


SPELLINGS = """
with r as (select doc_id, [item, 'Item ' || item || '.', ' item-' || lower(item), 'ITEM_' || item || ': Risk', 'ITEM' || item || '.', source] as r from documents),
u as (select doc_id, unnest(range(1, 7)) as i, r from r), w as (select doc_id, (i - 1)::bigint as k, r[i] as raw from u)
"""
#: What stands between two lines of a page in q_html_parsed: two ends of text nodes, the line feed itself, and the break.
_FIVE = "replace(text, chr(10), repeat(chr(10), 5))"

#: RE2 knows ASCII words only: letters, marks and figures beyond ASCII become underscores, which are word signs too.
_WORDS = "line"
for _kind in ("L", "M", "Nd", "Nl"):
    _WORDS = rf"regexp_replace({_WORDS}, '[^\x00-\x7F\P{{{_kind}}}]', '_', 'g')"

_NOT = ", ".join(f"'{x}'" for x in NO_BRANDS)

_FIRST = """(select p.price from px p where p.ticker = {t} and p.day between {d} and {d} + 6 order by p.day limit 1)"""

SQL = {
    "q_count": "select count(*) as n from lineitem",
    "q_peek_topk": "select o_orderkey, o_totalprice, o_orderpriority from orders order by o_totalprice desc, o_orderkey limit 10",
    "q_label_distribution": "select item, label, count(*) as n from finbert_section_scores group by 1, 2",
    "q_distinct_sorted": "select distinct ticker from finbert_section_scores where ticker is not null",
    "q_point_lookup": "select doc_id, ticker, item, n_chars from documents where ticker = 'KPCPQX' and item = '1A' order by doc_id limit 1",
    "q_form_date_filter": "select ticker, form, filing_date, accession_number from submissions where form = '10-K' and coalesce(try_strptime(filing_date, '%Y-%m-%d'), try_strptime(filing_date, '%Y%m%d'))::date between date '2020-01-01' and date '2024-12-31'",
    "q_in_filter": "select doc_id, item from documents where item in ('1A', '7')",
    "q_norm_label": SPELLINGS + f"""select doc_id, k, case when contains(s, 'item 1a') or s in ('1a', 'item1a') then '1A' when contains(s, 'item 1') or s in ('1', 'item1') then '1'
        when contains(s, 'item 7a') or s in ('7a', 'item7a') then '7A' when contains(s, 'item 7') or s in ('7', 'item7') then '7' else s end as label
        from (select doc_id, k, regexp_replace(lower({trim("coalesce(raw, 'none')")}), '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}.\\-:_]+', ' ', 'g') as s from w)""",
    "q_norm_item": SPELLINGS + f"select doc_id, k, case when s in ('1A.', '7.', '1.', '7A.') then s[:-2] else s end as item from (select doc_id, k, {trim("replace(replace(upper(raw), 'ITEM ', ''), 'ITEM', '')")} as s from w)",
    "q_coverage_summary": "select ticker, count(distinct year) as years_total, sum(case when item_1a = 1 and item_7 = 1 then 1 else 0 end)::bigint as years_ok_1a7 from parse_report where status = 'OK' and ticker is not null group by 1",
    "q_covered_tickers": "select ticker from parse_report where status = 'OK' and ticker is not null group by 1 having sum(case when item_1a = 1 and item_7 = 1 then 1 else 0 end) >= 3",
    "q_longest_per_group": "select ticker, item as key, length(text) as n, md5(text) as digest, src from (select ticker, item, coalesce(text, 'None') as text, source as src, row_number() over (partition by ticker, item order by length(coalesce(text, 'None')) desc, doc_id) as r from documents where ticker is not null) where r = 1",
    "q_compose_sections": """with b as (select accession, item, coalesce(text, 'None') as text, row_number() over (partition by accession, item order by length(coalesce(text, 'None')) desc, doc_id) as r from documents where accession is not null),
        w as (select accession, max(text) filter (item = '1') as t1, max(text) filter (item = '1A') as t1a, max(text) filter (item = '7') as t7, max(text) filter (item = '7A') as t7a from b where r = 1 group by 1),
        l as (select *, '1A' as section, t1a as main from w where t1a is not null union all select *, '7', t7 from w where t7 is not null),
        c as (select *, array_to_string(list_filter([coalesce(substr(t1, 1, 800), ''), main, coalesce(substr(t7a, 1, 800), '')], lambda x: x <> ''), chr(10) || chr(10)) as j from l),
        o as (select *, case when length(j) < 800 then main else j end as text from c)
        select accession, section, length(text) as text_len, md5(text) as digest, (t1 is not null)::bigint as has_1, (t1a is not null)::bigint as has_1a, (t7 is not null)::bigint as has_7, (t7a is not null)::bigint as has_7a from o""",
    "q_semi_join": "select doc_id from documents d where exists (select 1 from finbert_section_scores s where s.accession = d.accession and s.item = d.item)",
    "q_anti_join_resume": "select doc_id from documents d where not exists (select 1 from finbert_section_scores s where s.accession = d.accession and s.item = d.item)",
    "q_lookup_left_join": f"with k as (select {ticker()} as t, min(case when length(cik_str) >= 10 then cik_str else lpad(cik_str, 10, '0') end) as cik from ticker_map group by 1) select accession_number, coalesce(cik, 'unknown') as cik from submissions s left join k on k.t = {ticker('s.ticker')}",
    "q_sentiment_returns_join": "select s.ticker, s.fiscal_year, s.accession, s.item, s.polarity, s.label, r.buy_date, r.ret_30d, r.ret_60d, r.ret_90d from finbert_section_scores s join filing_returns r on s.ticker = r.ticker and s.fiscal_year = r.fiscal_year where s.item in ('1A', '7')",
    "q_union_by_name": "select c_name as name, c_acctbal as acctbal, c_mktsegment as segment from customer union all by name select s_acctbal as acctbal, s_name as name from supplier",
    "q_union_distinct": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "q_except": f"select {ticker()} as ticker from ticker_map except select {ticker()} from documents",
    "q_pivot_sections": "select accession, max(n_chars) filter (item = '1') as n_1, max(n_chars) filter (item = '1A') as n_1a, max(n_chars) filter (item = '7') as n_7, max(n_chars) filter (item = '7A') as n_7a from documents group by 1",
    "q_html_strip": PAGES + f"select doc_id, md5({STRIPPED}) as digest from g",
    "q_html_lines": PAGES + f"select doc_id, md5({_lines()}) as digest from g",
    "q_doc_score_top1": PAGES + f""", u as (select *, {STRIPPED} as text from g), v as (select *, {_hits} as hits from u),
        t as (select ticker, fiscal_year, doc_id, (least(octet_length(encode(html)) // 1024, 5000) + least(length(text) // 1000, 20000) + {_good} + hits * 1500 - ({_bad}) - case when length(text) < 1000 then 5000 else 0 end - case when hits = 0 then 3000 else 0 end)::bigint as score from v)
        select ticker, fiscal_year, doc_id, score from (select *, row_number() over (partition by ticker, fiscal_year order by score desc, doc_id) as r from t) where r = 1""",
    "q_marks": FILINGS + "select accession, pos, item from m",
    "q_mark_screens": FILINGS + SCREENS + "select accession, pos, toc, near, cross_ref, relating from s",
    "q_next_ender": FILINGS + ENDS + "select accession, pos, ends_at from e",
    "q_candidates": FILINGS + SCREENS + ENDS + CANDIDATES + "select accession, label, start, len as span_len, score from c",
    "q_best_span": FILINGS + SCREENS + ENDS + CANDIDATES + BEST + """select accession, section, start, "end", n_candidates, score, md5(text) as digest from x where text <> ''""",
    "q_parse_report": FILINGS + SCREENS + ENDS + CANDIDATES + BEST + ", y as (select f.accession, x.section, length(x.text) as n from f left join x using (accession)) select accession, case when max(coalesce(n, 0)) > 0 then 'OK' else 'NO_SECTIONS' end as status, "
    + ", ".join(f"count(*) filter (section = '{k}') as item_{k.lower()}, coalesce(max(n) filter (section = '{k}'), 0) as chars_{k.lower()}, max((n < {LEAST[k]})::bigint) filter (section = '{k}') as short_{k.lower()}" for k in LEAST)
    + ", coalesce(sum(n), 0)::bigint as chars_total from y group by 1",
    "q_sentence_split": SENTENCES + "select doc_id, k::bigint as k, sentence from e",
    "q_fragment_merge": SENTENCES + MERGED + "select doc_id, k, sentence from w",
    "q_brand_density": _sentences(r"regexp_replace(text, '\b[Tt]he\b', '<BRAND>', 'g')")
    + f""", t as (select doc_id, k, sentence, list_filter(string_split_regex(sentence, '{WS}+'), lambda x: x <> '') as t from e),
        d as (select doc_id, k, sentence, len(list_filter(t, lambda x: contains(x, '<BRAND>')))::double / len(t) as d from t)
        select doc_id, k::bigint as k, round(case when not contains(sentence, '<BRAND>') or d <= 0.25 then 1.0::double else greatest(0.2::double, 1.0::double - (d - 0.25) * 1.2) end, 6) as weight from d""",
    "q_section_scores": SCORED + f"select ticker, fiscal_year, filing_date, accession, item, n_sentences, {_micro('p')} as pos_micro, {_micro('u')} as neu_micro, {_micro('n')} as neg_micro, {_micro('(p - n)')} as polarity_micro, {_label('p', 'u', 'n')} as label from t",
    "q_section_scores_tuned": SCORED + f"select accession, item, {_micro('p')} as pos_micro, {_micro('u')} as neu_micro, {_micro('n')} as neg_micro, {_label('p', 'u', 'n')} as label from ({_tuned('t', 'p', 'u', 'n', 'accession, item')})",
    "q_sentence_scores": SCORED + f"select accession, item, k as sent_idx, sentence, round(pos, 6) as pos, round(neu, 6) as neu, round(neg, 6) as neg, {_label('pos', 'neu', 'neg')} as label from y",
    "q_gold_weighted": "select accession, item, count(*) as n, floor(sum(pos * weight) / sum(weight) * 1e6 + 1e-3)::bigint as pos_micro, floor(sum(neu * weight) / sum(weight) * 1e6 + 1e-3)::bigint as neu_micro, floor(sum(neg * weight) / sum(weight) * 1e6 + 1e-3)::bigint as neg_micro from (select distinct accession, item, sent_idx, sentence, pos, neu, neg, weight from finbert_sentence_scores where pos is not null and neu is not null and neg is not null) group by 1, 2",
    "q_retune_neutral": f"select accession, item, round(p, 6) as p, round(u, 6) as u, round(n, 6) as n, {_label('p', 'u', 'n')} as label from ({_tuned('finbert_section_scores where pos_mean is not null and neu_mean is not null and neg_mean is not null', 'pos_mean', 'neu_mean', 'neg_mean', 'accession, item')})",
    "q_json_navigate": "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none') as none from events",
    "q_zip_arrays": "select distinct ticker, form, filing_date, accession_number, primary_document from submissions where ticker is not null",
    "q_document_urls": """select accession_number, 'https://example.org/data/' || ltrim(cik_str, '0') || '/' || replace(accession_number, '-', '') || '/' || primary_document as url,
        regexp_replace(concat_ws('_', ticker, filing_date, accession_number) || case when regexp_matches(primary_document, '\\.[^./]+$') then regexp_extract(primary_document, '(\\.[^./]+)$', 1) else '.html' end, '[^A-Za-z0-9._-]', '_', 'g') as name
        from submissions where primary_document is not null""",
    "q_returns_from_prices": f"""with px as (select {ticker()} as ticker, quoted_at::date as day, min(close_px) as price from price_quotes where ticker is not null and quoted_at is not null and close_px is not null group by 1, 2),
        b as (select distinct {ticker()} as ticker, filing_date from filing_returns where ticker is not null and filing_date is not null),
        c as (select *, (select min(p.day) from px p where p.ticker = b.ticker and p.day between b.filing_date and b.filing_date + 6) as buy_date from b),
        x as (select *, {_FIRST.format(t='c.ticker', d='c.buy_date')} as bp, {', '.join(_FIRST.format(t='c.ticker', d=f'(c.buy_date + {n})') + f' as s{n}' for n in (30, 60, 90))} from c)
        select ticker, filing_date, buy_date, {', '.join(f'round(s{n} / bp - 1, 6) as ret_{n}d' for n in (30, 60, 90))} from x""",
    "q_windowed_counts": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "q_summarize": f"select doc_id, case when length(s) > 240 then substr(s, 1, 240) || '…' else s end as preview from (select doc_id, regexp_replace({trim('text')}, '{WS}+', ' ', 'g') as s from documents)",
    "q_safe_name": "select doc_id, regexp_replace(concat_ws('/', ticker, item, source), '[^A-Za-z0-9._-]', '_', 'g') as name from documents",
    "q_xml_sniff": """select doc_id, doc_id % 7 in (0, 1, 2, 3, 4) or regexp_matches(text, '(?i)<xbrli:|<xbrl[ >]') or regexp_matches(text, '(?i)</?document[^>]*type=[''"]xml[''"]') as xml from documents where text is not null""",
    "q_html_parsed": f"select doc_id, md5({_tidy(_FIVE)}) as digest from documents where text is not null",
    "q_diagnose": FILINGS + SCREENS + ENDS + CANDIDATES + f""", nr as (select accession, item as label, count(*) as n_raw from m group by 1, 2),
        r as (select *, row_number() over (partition by accession, label order by score desc, len desc, ord) as rank, count(*) over (partition by accession, label) as n_candidates, regexp_replace({trim('substr(text, start + 1, least(300, len))')}, '{WS}+', ' ', 'g') as s from c)
        select accession, label, n_raw, n_candidates, rank, start, len as span_len, score, case when length(s) > 240 then substr(s, 1, 240) || '…' else s end as preview from r join nr using (accession, label) where rank <= 5""",
    "q_prepared_sections": f"select ticker, fiscal_year, item, fiscal_year || '-01-01' as filing_date, concat_ws('-', ticker, fiscal_year) as accession, length(text) as n from documents where item in ('1A', '7') and {trim('text')} <> ''",
    "q_select_one": "select 1::int as one",
    "q_sql_over_views": "select item, label, count(*) as n from finbert_section_scores where item in ('1A', '7') group by 1, 2",
    "q_alias_discovery": f"""with l as (select doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x{{0B}}\\f\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')) as line from documents where text is not null),
        w as (select doc_id, {_WORDS} as line from l), t as (select doc_id, regexp_extract_all(line, '\\b[A-Z][A-Za-z0-9&\\-.''’]{{1,}}\\b') as t from w),
        g as (select doc_id, unnest(range(1, len(t) + 1)) as i, t from t),
        a as (select doc_id, t[i] as alias from g where t[i] not in ({_NOT}) union all
              select doc_id, t[i] || ' ' || t[i + 1] from g where i + 1 <= len(t) and t[i] not in ({_NOT}) union all
              select doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] from g where i + 2 <= len(t) and t[i] not in ({_NOT}))
        select doc_id, alias, count(*) as n from a where alias not in ({_NOT}) group by 1, 2 having count(*) >= 4""",
}
