"""The same queries stated a second time in SQL, for checking.

Written for the checking engine and on purpose otherwise than the library:
patterns one by one, pairs of text and term tried by regex, theta joins.
"""

from __future__ import annotations

from postroom.functions.charsets import blanks
from postroom.functions.text import (
    BODY_WIDTH,
    ENTITIES,
    FALLBACK_WIDTH,
    HEADER_NAMES,
    SENDER_WIDTH,
    SUBJECT_WIDTH,
)
from postroom.operators.prompts import CONTEXT, FALLBACK_PROMPT, MESSAGE_PROMPT
from postroom.plans import fixtures
from postroom.plans.queries import ORGANISATION, PREDICTED_AT, QUEUE_LENGTH
from postroom.sources.files import MISSING

_WORD = r"[\p{L}\p{N}_]"


def _text(value: str) -> str:
    """A string literal; control characters by number."""
    parts, plain = [], ""
    for char in value:
        if char < " ":
            parts += [f"'{plain}'", f"chr({ord(char)})"]
            plain = ""
        else:
            plain += char.replace("'", "''")
    parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")"


_BLANKS = _text(blanks())


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _replaced(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"


def _folded(x: str) -> str:
    return _replaced(f"strip_accents({x})", r"[^\x00-\x7F]", "")


def _without_html(x: str) -> str:
    x = _replaced(x, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _without_headers(x: str) -> str:
    for name in HEADER_NAMES:
        x = _replaced(x, f"{name}:.*", "", "gi")
    x = _replaced(x, "-{2,}.*Original Message.*-{2,}", "", "gi")
    return _replaced(x, "_{3,}", "")


_NON_BLANK = r"[^ \t-\r\x1c-\x1f]"


def _without_urls(x: str) -> str:
    return _replaced(x, rf"http{_NON_BLANK}+|www\.{_NON_BLANK}+", " ")


def _without_addresses(x: str) -> str:
    return _replaced(x, f"{_NON_BLANK}+@{_NON_BLANK}+", " ")


def _cleaned(x: str) -> str:
    x = _without_addresses(_without_urls(_without_headers(_without_html(_folded(x)))))
    x = f"lower({_replaced(x, '[^a-zA-Z]', ' ')})"
    return f"trim({_replaced(x, ' +', ' ')})"


def _cases(values) -> str:
    return " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else _text(v)}" for i, v in enumerate(values)
    )


_MESSAGES = f"""m AS (
SELECT CAST(doc_id AS VARCHAR) AS guid, doc_id,
 CASE WHEN doc_id % 97 <> 0 THEN doc_id END AS minute,
 source || '@mail.example.com' AS sender,
 CASE doc_id % 7 {_cases(fixtures.RECIPIENTS)} END AS rcpt,
 CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS subject,
 CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body,
 CASE doc_id % 4 WHEN 1 THEN 'Unclassified' WHEN 2 THEN 'Billing' WHEN 3 THEN 'Legal' END AS predicted
FROM documents)"""

_WEIGHTED = f"""cleaned AS (SELECT guid, {_cleaned('subject')} AS s, {_cleaned('body')} AS b FROM m),
w AS (SELECT guid, s || ' ' || s || ' ' || b AS text FROM cleaned)"""

_LEX_RAW = f"lex_raw AS ({fixtures.values_sql(fixtures.LEXICON, 'code0', 'term0')})"
_LEX = f"""{_LEX_RAW},
lex AS (SELECT row_no, {_strip('code0')} AS code, lower({_strip('term0')}) AS term
 FROM lex_raw WHERE code0 IS NOT NULL AND term0 IS NOT NULL)"""
_INT_RAW = f"int_raw AS ({fixtures.values_sql(fixtures.INTENTS, 'code0', 'intent0', 'email0')})"
_INT = f"""{_INT_RAW},
intents AS (SELECT row_no, {_strip('code0')} AS intent_code, {_strip('intent0')} AS intent,
 lower({_strip('email0')}) AS email FROM int_raw WHERE code0 IS NOT NULL AND email0 IS NOT NULL),
labelled AS (SELECT row_no, {_strip('code0')} AS intent_code, {_strip('intent0')} AS intent, email0 AS email
 FROM int_raw WHERE code0 IS NOT NULL AND intent0 IS NOT NULL)"""

_PART = f"""part_raw AS (SELECT {', '.join(fixtures.PART_LEXICON)} FROM part),
part_all AS (SELECT row_no, {_strip('Category_Code')} AS code, lower({_strip('Term')}) AS term
 FROM part_raw WHERE Category_Code IS NOT NULL AND Term IS NOT NULL),
part_lex AS (SELECT * FROM part_all WHERE length(term) >= 3)"""
_CUSTOMER = f"""cust_raw AS (SELECT {', '.join(fixtures.CUSTOMER_INTENTS)} FROM customer),
cust_intents AS (SELECT row_no, {_strip('Intent_Code')} AS intent_code, {_strip('Intent')} AS intent,
 lower({_strip('Email')}) AS email FROM cust_raw WHERE Intent_Code IS NOT NULL AND Email IS NOT NULL),
cust_labelled AS (SELECT row_no, {_strip('Intent_Code')} AS intent_code, {_strip('Intent')} AS intent, Email AS email
 FROM cust_raw WHERE Intent_Code IS NOT NULL AND Intent IS NOT NULL)"""

# Each blank is doubled so that neighbouring matches need not share one.
_COUNTS = f"""{_MESSAGES}, {_WEIGHTED}, {_LEX},
cats AS (SELECT code, min(row_no) AS cat_no FROM lex GROUP BY code),
doubled AS (SELECT guid, replace(text, ' ', '  ') AS text FROM w),
counts AS (
 SELECT guid, cat_no, code, term,
  len(regexp_extract_all(text, '(^| )' || replace(term, ' ', '  ') || '( |$)')) AS n
 FROM doubled, (SELECT DISTINCT code, term FROM lex WHERE regexp_full_match(term, '[a-z]+( [a-z]+)*'))
 JOIN cats USING (code)
 WHERE contains(text, replace(term, ' ', '  ')))"""

# For phrases of ASCII words: any separator but the blank becomes one mark, any
# other letter an underscore, and separators are doubled.
_DOUBLED = _replaced(
    _replaced(_replaced("text", r"[^\p{L}\p{N}_ ]", r"\x01").replace(r"'\x01'", "chr(1)"), r"[^\x00-\x7F]", "_"),
    r"([ \x01])",
    r"\1\1",
)

_HITS = f"""{_MESSAGES}, {_LEX}, {_INT},
rlex AS (SELECT code, term, count(*) AS mult FROM lex WHERE length(term) >= 3 GROUP BY code, term),
cats AS (SELECT code, min(row_no) AS cat_no FROM lex WHERE length(term) >= 3 GROUP BY code),
low AS (SELECT guid, lower(subject || ' ' || body) AS text FROM m),
tokens AS (SELECT DISTINCT guid, token FROM
 (SELECT guid, unnest(regexp_extract_all(text, '{_WORD}+')) AS token FROM low)
 WHERE regexp_full_match(token, '[a-z0-9]+')),
words AS (SELECT guid, code, term, CAST(1 AS BIGINT) AS times, mult, mult AS score
 FROM tokens JOIN rlex ON token = term WHERE NOT contains(term, ' ')),
marked AS (SELECT guid, {_DOUBLED} AS text FROM low),
found AS (SELECT guid, code, term, mult, CAST(len(regexp_extract_all(text,
  '(^|[ \x01])' || replace(term, ' ', '  ') || '([ \x01]|$)')) AS BIGINT) AS times
 FROM marked, rlex WHERE contains(term, ' ') AND contains(text, replace(term, ' ', '  '))),
phrases AS (SELECT guid, code, term, times, mult, 2 * mult * times AS score FROM found WHERE times > 0),
hits AS (SELECT * FROM words UNION ALL SELECT * FROM phrases),
totals AS (SELECT guid, code, sum(score) AS score, sum(times * mult * length(term)) AS letters,
 sum(times * mult) AS repeats FROM hits GROUP BY guid, code),
scores_count AS (SELECT guid, cat_no, code, CAST(score AS BIGINT) AS score FROM totals JOIN cats USING (code)),
scores_weighted AS (SELECT * FROM (SELECT guid, cat_no, code, CAST(trunc(score
 * (CAST(letters AS DOUBLE) / CAST(repeats AS DOUBLE) / 5.0)) AS BIGINT) AS score
 FROM totals JOIN cats USING (code)) WHERE score > 0)"""


def _routed(intents: str, cats: str) -> str:
    return f"""SELECT i.row_no, i.intent_code, i.intent, i.email,
 coalesce(arg_min(c.code, c.cat_no), i.intent_code) AS category, min(c.cat_no) AS cat_no
 FROM {intents} i LEFT JOIN {cats} c ON i.intent_code = c.code
 OR starts_with(i.intent_code, c.code || '_') OR starts_with(c.code, i.intent_code)
 GROUP BY i.row_no, i.intent_code, i.intent, i.email"""


def _decisions(address: str = "exact", score: str = "count") -> str:
    agrees = {
        "exact": "email = addr",
        "domain": "split_part(email, '@', -1) = CASE WHEN contains(addr, '@') THEN split_part(addr, '@', -1) ELSE '' END",
        "fuzzy": "(contains(addr, email) OR contains(email, addr))",
    }[address]
    return f"""{_HITS},
routed AS ({_routed('intents', 'cats')}),
ranked AS (SELECT guid, row_number() OVER (PARTITION BY guid ORDER BY score DESC, cat_no) AS rank, code, score
 FROM scores_{score}),
cand AS (SELECT guid, rank, category, row_no, intent_code, email FROM (
 SELECT guid, rank, category, row_no, intent_code, email,
  row_number() OVER (PARTITION BY guid, intent_code ORDER BY rank, row_no) AS k
 FROM ranked JOIN routed ON ranked.code = routed.category) WHERE k = 1),
addr AS (SELECT guid, rcpt, lower({_strip('rcpt')}) AS addr FROM m),
judged AS (SELECT cand.*, coalesce(coalesce(rcpt, '') <> '' AND {agrees}, false) AS ok FROM cand JOIN addr USING (guid)),
kept AS (SELECT *, max(ok) OVER (PARTITION BY guid) AS any_ok FROM judged),
per AS (SELECT guid, string_agg(intent_code, ',' ORDER BY rank, row_no) AS candidate_intents,
 string_agg(intent_code, ',' ORDER BY rank, row_no) FILTER (WHERE ok OR NOT any_ok) AS final_intents,
 max(any_ok) AS any_ok FROM kept GROUP BY guid),
matched AS (SELECT guid, string_agg(code, ',' ORDER BY rank) AS matched_categories FROM ranked GROUP BY guid),
home AS (SELECT email, string_agg(intent_code, ',' ORDER BY row_no) AS codes FROM
 (SELECT email, intent_code, min(row_no) AS row_no FROM intents GROUP BY email, intent_code) GROUP BY email),
decided AS (SELECT m.guid, coalesce(matched_categories, '') AS matched_categories,
 coalesce(candidate_intents, '') AS candidate_intents,
 CASE WHEN matched_categories IS NOT NULL THEN coalesce(final_intents, 'Unclassified')
  ELSE coalesce(codes, 'Unclassified') END AS final_intents,
 CASE WHEN matched_categories IS NULL AND codes IS NOT NULL THEN 'email_only'
  WHEN matched_categories IS NULL THEN 'unmatched'
  WHEN candidate_intents IS NULL THEN 'keyword_no_intent'
  WHEN any_ok THEN 'keyword+email_{address}' ELSE 'keyword_only' END AS match_source,
 CASE WHEN matched_categories IS NULL AND codes IS NULL THEN 'low'
  WHEN matched_categories IS NULL OR (candidate_intents IS NOT NULL AND NOT any_ok) THEN 'medium'
  ELSE 'high' END AS confidence
 FROM m LEFT JOIN matched USING (guid) LEFT JOIN per USING (guid)
 LEFT JOIN addr USING (guid) LEFT JOIN home ON addr.addr = home.email AND coalesce(addr.rcpt, '') <> '')"""


def _pruned(address: str) -> str:
    return f"""WITH {_decisions(address)}
SELECT guid, match_source, CAST(row_number() OVER (PARTITION BY guid ORDER BY rank, row_no) - 1 AS INTEGER) AS place,
 intent_code FROM kept JOIN decided USING (guid) WHERE ok OR NOT any_ok"""


def _filled(template: str, *values: str) -> str:
    pieces = [_text(p) for p in template.split("%s")]
    out = [pieces[0]]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [value, piece]
    return "concat(" + ", ".join(out) + ")"


def _field(x: str, width: int) -> str:
    return f"substr({_strip(x)}, 1, {width})"


_PROMPT = _filled(
    MESSAGE_PROMPT,
    _field("sender", SENDER_WIDTH),
    _field("subject", SUBJECT_WIDTH),
    _field("body", BODY_WIDTH),
)
_WAITING = "(predicted IS NULL OR predicted = 'Unclassified') AND (body IS NOT NULL OR subject IS NOT NULL)"


def _prompt_lines(lexicon: str) -> str:
    return f"""lines AS (SELECT min(row_no) AS cat_no, code,
 '  ' || code || ': ' || string_agg(term, ', ' ORDER BY row_no) AS line FROM (
 SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_no) AS k FROM {lexicon}) WHERE k <= 20 GROUP BY code)"""


def _shots(labelled: str) -> str:
    return f"""shots AS (SELECT row_no, intent_code, intent, email FROM (
 SELECT *, row_number() OVER (PARTITION BY intent_code ORDER BY row_no) AS k FROM {labelled}
 WHERE intent_code <> 'Unclassified') WHERE k = 1 ORDER BY row_no LIMIT 8)"""


def _context(lexicon: str, labelled: str) -> str:
    shot = "'  Sender: ' || coalesce(email, '') || chr(10) || '  -> Intent: ' || intent || '  |  Code: ' || intent_code"
    filled = _filled(
        CONTEXT,
        _text(ORGANISATION),
        "(SELECT string_agg(line, chr(10) ORDER BY cat_no) FROM lines)",
        f"(SELECT string_agg(intent_code, ' | ' ORDER BY intent_code) FROM (SELECT DISTINCT intent_code FROM {labelled}))",
        f"(SELECT string_agg({shot}, chr(10) ORDER BY row_no) FROM shots)",
    )
    return f"{_prompt_lines(lexicon)}, {_shots(labelled)}, ctx AS (SELECT {filled} AS context)"


_ASKED = f"""{_MESSAGES}, {_LEX}, {_INT}, {_context('lex', 'labelled')},
asked AS (SELECT guid, concat('<s>[INST] ', context, chr(10), chr(10), {_PROMPT}, ' [/INST]') AS prompt
 FROM m, ctx WHERE {_WAITING})"""

_ANSWERED = f"""{_ASKED},
answered AS (SELECT guid,
 CASE WHEN length(prompt) % 11 <> 0 THEN '{{"intent": "label ' || (length(prompt) % 5) || '", "intent_code": "'
  || CASE length(prompt) % 4 WHEN 0 THEN 'Billing' WHEN 1 THEN 'legal' WHEN 2 THEN 'Account_Move' ELSE 'Nope' END
  || '"}}' END AS raw,
 CASE WHEN length(prompt) % 11 = 0 THEN 'no answer for ' || length(prompt) || ' characters' END AS error FROM asked)"""


def _member(name: str) -> str:
    return _strip(
        f"CASE json_type(j, '$.{name}') WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN"
        f" CASE json_extract_string(j, '$.{name}') WHEN 'true' THEN 'True' ELSE 'False' END"
        f" ELSE coalesce(json_extract_string(j, '$.{name}'), '') END"
    )


def _parsed(source: str) -> str:
    # The checking engine's JSON check lets a trailing comma pass, which is no JSON.
    return f"""found AS (SELECT guid, regexp_extract(raw, '\\{{[^{{}}]+\\}}') AS part FROM {source}),
js AS (SELECT guid, CASE WHEN json_valid(part) AND NOT regexp_matches(part, ',\\s*\\}}') THEN part END AS j FROM found),
got AS (SELECT guid, CASE WHEN j IS NOT NULL THEN {_member('intent')} END AS label,
 CASE WHEN j IS NOT NULL THEN {_member('intent_code')} END AS code FROM js),
allowed AS (SELECT DISTINCT intent_code FROM labelled),
same AS (SELECT lower(intent_code) AS low, min(intent_code) AS intent_code FROM allowed GROUP BY 1),
parsed AS (SELECT guid,
 CASE WHEN coalesce(a.intent_code, s.intent_code) IS NULL THEN 'Unclassified' ELSE label END AS predicted_intent,
 coalesce(a.intent_code, s.intent_code, 'Unclassified') AS predicted_code
 FROM got LEFT JOIN allowed a ON code = a.intent_code LEFT JOIN same s ON lower(code) = s.low)"""


def _texts(step, table: str, key: str, col: str) -> str:
    return f"SELECT {key} AS id, {step(col)} AS text FROM {table}"


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["lexicon_terms"] = """WITH t AS (
SELECT item_id, 0 AS place, '' AS kind, unnest(string_split(text, ' ')) AS term FROM benchmark
UNION ALL SELECT item_id, 1, '_head', unnest(string_split(text, ' ')[1:5]) FROM benchmark
UNION ALL SELECT item_id, k, kinds[k + 1], NULL FROM benchmark,
 (SELECT unnest([0, 1, 2]) AS k, ['', '_head', '_none'] AS kinds))
SELECT DISTINCT item_id AS file_no, CAST(place AS INTEGER) AS place, 'item_' || item_id || kind AS code,
 nullif(lower(trim(term)), '') AS term FROM t"""
    out["lexicon_table"] = f"""WITH {_PART},
cats AS (SELECT code, min(row_no) AS cat_no FROM part_lex GROUP BY code)
SELECT cat_no, code, term, min(row_no) AS row_no, count(*) AS mult
FROM part_lex JOIN cats USING (code) GROUP BY cat_no, code, term"""
    out["lexicon_profile"] = f"WITH {_PART} SELECT code, count(*) AS terms FROM part_all GROUP BY code"
    out["intent_dim"] = f"WITH {_CUSTOMER} SELECT row_no, intent_code, intent, email, '' AS method FROM cust_intents"
    out["valid_codes"] = f"WITH {_CUSTOMER} SELECT DISTINCT intent_code FROM cust_labelled ORDER BY 1"
    out["few_shots"] = f"WITH {_CUSTOMER}, {_shots('cust_labelled')} SELECT * FROM shots ORDER BY row_no"
    out["intent_routing"] = f"""WITH {_PART}, {_CUSTOMER},
cats AS (SELECT code, min(row_no) AS cat_no FROM part_lex GROUP BY code) {_routed('cust_intents', 'cats')}"""
    out["kb_profile"] = f"""WITH {_PART}, {_CUSTOMER}
SELECT (SELECT count(DISTINCT code) FROM part_lex) AS categories, (SELECT count(*) FROM part_lex) AS terms,
 (SELECT count(DISTINCT term) FROM part_lex WHERE NOT contains(term, ' ')) AS single_word_terms,
 (SELECT count(DISTINCT term) FROM part_lex WHERE contains(term, ' ')) AS phrases,
 (SELECT count(*) FROM cust_intents) AS records,
 (SELECT count(DISTINCT intent_code) FROM cust_intents) AS intent_codes,
 (SELECT count(DISTINCT email) FROM cust_intents) AS addresses,
 (SELECT count(DISTINCT split_part(email, '@', -1)) FROM cust_intents) AS domains"""

    out["ascii_fold"] = _texts(_folded, "documents", "doc_id", "text")
    out["strip_html"] = _texts(_without_html, "pages", "page_id", "html")
    out["strip_headers"] = _texts(
        _without_headers, "documents", "doc_id",
        "concat('From: ', source, chr(10), 'Subject: x', chr(10), '-- original message --', chr(10), text,"
        " chr(10), '____', chr(10), 'Bcc: ', source)",
    )
    out["strip_urls"] = _texts(_without_urls, "pages", "page_id", "html")
    out["strip_addresses"] = _texts(_without_addresses, "documents", "doc_id", "text")
    out["clean_text"] = f"""SELECT 'documents' AS table_name, doc_id AS id, CAST(NULL AS BIGINT) AS turn,
 {_cleaned('text')} AS text FROM documents
UNION ALL SELECT 'pages', page_id, NULL, {_cleaned('html')} FROM pages
UNION ALL SELECT 'conversations', conv_id, turn, {_cleaned('text')} FROM conversations"""
    out["weighted_text"] = f"WITH {_MESSAGES}, {_WEIGHTED} SELECT guid, text FROM w"

    out["keyphrase_counts"] = f"WITH {_COUNTS} SELECT guid, cat_no, code, term, n FROM counts WHERE n > 0"
    # Words and pairs by position; a pair of one word repeated counts every
    # second place of each unbroken run.
    out["keyphrase_counts_wide"] = f"""WITH {_MESSAGES}, {_WEIGHTED},
items AS (SELECT item_id, string_split({_cleaned('text')}, ' ') AS ws FROM benchmark),
bl AS (SELECT DISTINCT item_id AS cat_no, 'item_' || item_id AS code, term FROM (
 SELECT item_id, unnest(ws) AS term FROM items
 UNION ALL SELECT item_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM items)),
ww AS (SELECT guid, string_split(trim(text), ' ') AS ws FROM w),
places AS (SELECT guid, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM ww),
nx AS (SELECT guid, pos, word, lead(word) OVER (PARTITION BY guid ORDER BY pos) AS nxt FROM places),
one AS (SELECT guid, word AS term, count(*) AS n FROM places GROUP BY 1, 2),
two AS (SELECT guid, word || ' ' || nxt AS term, count(*) AS n FROM nx WHERE nxt IS NOT NULL AND word <> nxt GROUP BY 1, 2),
runs AS (SELECT guid, word, pos - row_number() OVER (PARTITION BY guid, word ORDER BY pos) AS run FROM nx WHERE word = nxt),
rep AS (SELECT guid, word || ' ' || word AS term, sum((size + 1) // 2) AS n
 FROM (SELECT guid, word, run, count(*) AS size FROM runs GROUP BY 1, 2, 3) GROUP BY 1, 2),
found AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM rep)
SELECT guid, cat_no, code, term, CAST(n AS BIGINT) AS n FROM found JOIN bl USING (term)"""
    out["keyphrase_json"] = f"""WITH {_COUNTS},
per AS (SELECT guid, cat_no, code, '"' || code || '":{{' || string_agg('"' || term || '":' || n, ','
 ORDER BY length(term) DESC, term) || '}}' AS part FROM counts WHERE n > 0 GROUP BY guid, cat_no, code),
js AS (SELECT guid, '{{' || string_agg(part, ',' ORDER BY cat_no) || '}}' AS keyphrase_stats FROM per GROUP BY guid)
SELECT m.guid, keyphrase_stats FROM m LEFT JOIN js USING (guid)"""
    # Categories in the order of their names in the JSON text; two hold no terms.
    out["match_summary_json"] = f"""WITH {_COUNTS},
every AS (SELECT code, min(row_no) AS place FROM lex_raw0 GROUP BY code
 UNION ALL SELECT 'Empty', 1000 UNION ALL SELECT 'Bare', 1001),
hit AS (SELECT code, count(DISTINCT guid) AS matched FROM counts WHERE n > 0 GROUP BY code)
SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS place, code, coalesce(matched, 0) AS matched,
 CAST(100.0 AS DOUBLE) * coalesce(matched, 0) / (SELECT count(*) FROM m) AS pct
FROM every LEFT JOIN hit USING (code)""".replace("lex_raw0", "(SELECT row_no, code0 AS code FROM lex_raw)")
    # Delimited cells that read as missing come back as null.
    gone = ", ".join(_text(mark) for mark in MISSING)
    for kind in ("parquet", "csv", "tsv"):
        field = (lambda x: x) if kind == "parquet" else (lambda x: f"CASE WHEN {x} NOT IN ({gone}) THEN {x} END")
        out[f"enriched_{kind}"] = f"""WITH {_COUNTS},
per AS (SELECT guid, cat_no, code, '"' || code || '":{{' || string_agg('"' || term || '":' || n, ','
 ORDER BY length(term) DESC, term) || '}}' AS part FROM counts WHERE n > 0 GROUP BY guid, cat_no, code),
js AS (SELECT guid, '{{' || string_agg(part, ',' ORDER BY cat_no) || '}}' AS keyphrase_stats FROM per GROUP BY guid)
SELECT m.guid, {field('subject')} AS subject, {field('body')} AS body, keyphrase_stats FROM m LEFT JOIN js USING (guid)"""
    out["match_summary"] = f"""WITH {_COUNTS},
hit AS (SELECT code, count(DISTINCT guid) AS matched FROM counts WHERE n > 0 GROUP BY code)
SELECT cat_no, code, coalesce(matched, 0) AS matched,
 CAST(100.0 AS DOUBLE) * coalesce(matched, 0) / (SELECT count(*) FROM m) AS pct FROM cats LEFT JOIN hit USING (code)"""

    out["token_set"] = f"WITH {_HITS} SELECT guid, token FROM tokens"
    out["single_word_hits"] = f"WITH {_HITS} SELECT guid, code, term, score FROM words"
    out["phrase_hits"] = f"WITH {_HITS} SELECT guid, code, term, times, score FROM phrases"
    out["keyword_hits"] = f"WITH {_HITS} SELECT guid, cat_no, code, term, times * mult AS n FROM hits JOIN cats USING (code)"
    out["category_scores"] = f"WITH {_HITS} SELECT * FROM scores_count"
    out["category_scores_weighted"] = f"WITH {_HITS} SELECT * FROM scores_weighted"
    out["ranked_categories"] = f"WITH {_decisions()} SELECT guid, rank, code, score FROM ranked"
    out["candidate_intents"] = f"WITH {_decisions()} SELECT guid, rank, category, row_no, intent_code, email FROM cand"
    for address in ("exact", "domain", "fuzzy"):
        out[f"prune_{address}"] = _pruned(address)
    out["recipient_only"] = f"""WITH {_decisions()},
codes AS (SELECT guid, string_split(final_intents, ',') AS cs FROM decided WHERE match_source = 'email_only')
SELECT guid, CAST(unnest(range(len(cs))) AS INTEGER) AS place, unnest(cs) AS intent_code FROM codes"""
    out["triage"] = f"WITH {_decisions()} SELECT * FROM decided"
    out["triage_weighted_domain"] = f"WITH {_decisions('domain', 'weighted')} SELECT * FROM decided"
    out["triage_audit"] = f"""WITH {_decisions()},
lists AS (SELECT guid, code, string_agg(trim(repeat('"' || term || '",', CAST(times * mult AS INTEGER)), ','), ','
 ORDER BY term) AS found FROM hits GROUP BY guid, code),
maps AS (SELECT guid, '{{' || string_agg('"' || code || '":[' || found || ']', ',' ORDER BY code) || '}}' AS keyword_hits
 FROM lists GROUP BY guid)
SELECT guid, match_source, coalesce(keyword_hits, '{{}}') AS keyword_hits FROM decided LEFT JOIN maps USING (guid)"""
    fallback = _filled(
        FALLBACK_PROMPT,
        "(SELECT string_agg(intent_code, ' | ' ORDER BY r) FROM"
        " (SELECT intent_code, min(row_no) AS r FROM intents GROUP BY intent_code))",
        f"substr(subject || ' ' || body, 1, {FALLBACK_WIDTH})",
    )
    out["triage_with_fallback"] = f"""WITH {_decisions()},
fb AS (SELECT guid, length(concat('<s>[INST] ', {fallback}, ' [/INST]')) AS n FROM m)
SELECT guid, matched_categories, candidate_intents,
 CASE WHEN match_source <> 'unmatched' THEN final_intents WHEN n % 5 = 0 THEN 'Unclassified'
  ELSE CASE n % 3 WHEN 0 THEN 'Outage,' WHEN 1 THEN 'Acc,' ELSE '' END || 'Legal' END AS final_intents,
 CASE match_source WHEN 'unmatched' THEN 'llm_fallback' ELSE match_source END AS match_source, confidence
FROM decided JOIN fb USING (guid)"""
    out["source_breakdown"] = f"""WITH {_decisions()} SELECT match_source, count(*) AS n,
 CAST(100.0 AS DOUBLE) * count(*) / (SELECT count(*) FROM m) AS pct FROM decided GROUP BY match_source"""
    out["multi_intent"] = f"""WITH {_decisions('domain')} SELECT count(*) FILTER (WHERE contains(final_intents, ',')) AS multi,
 count(*) AS total FROM decided"""

    columns = 'guid, subject, body, rcpt AS "to", sender AS "from"'
    out["work_queue"] = f"""WITH {_MESSAGES} SELECT {columns} FROM m WHERE {_WAITING}
ORDER BY minute DESC NULLS LAST, guid LIMIT {QUEUE_LENGTH}"""
    out["backlog"] = f"WITH {_MESSAGES} SELECT {columns} FROM m WHERE {_WAITING}"
    out["apply_predictions"] = f"""WITH {_MESSAGES},
p AS (SELECT CAST(doc_id AS VARCHAR) AS guid, CASE WHEN quality = 1 THEN 'Toxic_' || toxic ELSE 'Account' END AS np FROM labels)
SELECT m.guid, subject, body, CASE WHEN np IS NOT NULL THEN np ELSE predicted END AS predicted,
 CASE WHEN np IS NOT NULL THEN '{PREDICTED_AT}' END AS predicted_date FROM m LEFT JOIN p USING (guid)"""
    out["keyphrase_counts_shuffled"] = out["keyphrase_counts_wide"]
    out["upsert_buckets"] = f"""WITH {_MESSAGES},
p AS (SELECT CAST(doc_id AS VARCHAR) AS guid, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)
SELECT m.guid, subject,
 CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'Legal' WHEN p.guid IS NOT NULL THEN 'Account' ELSE predicted END AS predicted,
 CASE WHEN toxic = 1 THEN '2024-06-03 12:00:00' WHEN quality = 1 THEN '2024-06-02 12:00:00'
  WHEN p.guid IS NOT NULL THEN '{PREDICTED_AT}' END AS predicted_date FROM m LEFT JOIN p USING (guid)"""
    out["prediction_as_of"] = """WITH made AS (
SELECT o_custkey % 100 AS guid, make_timestamp((1704067200 + o_orderkey * 7919 % 2592000) * 1000000) AS made_at,
 o_orderkey, o_orderpriority FROM orders),
once AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY guid, made_at ORDER BY o_orderkey DESC, o_orderpriority DESC) = 1)
SELECT e.event_id, e.user_id AS guid, o_orderkey, o_orderpriority
FROM events e ASOF LEFT JOIN once ON once.guid = e.user_id AND e.ts >= once.made_at"""
    out["intents_in_force"] = f"""WITH {_MESSAGES},
valid AS (SELECT c_custkey, c_nationkey AS nation, c_custkey * 3571 % 1440 AS since,
 CASE WHEN c_custkey % 17 = 0 THEN c_custkey % 290 * 60 ELSE c_custkey % 90 END AS minutes FROM customer)
SELECT guid, c_custkey, nation FROM m JOIN valid
ON CAST(regexp_extract(sender, '[0-9]+') AS INTEGER) = nation AND since <= minute AND minute < since + minutes"""
    out["sender_threads"] = f"""WITH {_MESSAGES},
steps AS (SELECT guid, sender, minute, minute - lag(minute) OVER w AS since, lead(minute) OVER w - minute AS later
 FROM m WHERE minute IS NOT NULL AND sender IS NOT NULL WINDOW w AS (PARTITION BY sender ORDER BY minute, guid)),
told AS (SELECT *, sum(CASE WHEN since IS NULL OR since * 60 >= 1300 THEN 1 ELSE 0 END) OVER (PARTITION BY sender ORDER BY minute, guid)::BIGINT AS thread_no FROM steps)
SELECT guid, sender, thread_no, row_number() OVER (PARTITION BY sender, thread_no ORDER BY minute, guid) AS place,
 since * 60000000 AS since_previous, later * 60000000 AS until_next FROM told"""
    out["recipient_load"] = f"""WITH {_MESSAGES}
SELECT guid, rcpt AS recipient, count(*) OVER (PARTITION BY rcpt ORDER BY minute RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS n
FROM m WHERE minute IS NOT NULL AND rcpt IS NOT NULL"""
    out["arrivals_by_hour"] = f"""WITH {_MESSAGES},
hours AS (SELECT minute // 60 AS hour, predicted, count(*) AS n FROM m WHERE minute IS NOT NULL GROUP BY ALL)
SELECT strftime(make_timestamp((1704067200 + hour * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS start, predicted, n
FROM hours WHERE hour * 60 + 60 <= (SELECT max(minute) FROM m) - 60"""
    out["label_rollup"] = f"""WITH {_MESSAGES},
counted AS (SELECT predicted, rcpt AS recipient, sender, count(*) AS n, (3 - grouping(predicted) - grouping(rcpt) - grouping(sender))::INTEGER AS level
 FROM m GROUP BY ROLLUP (predicted, rcpt, sender))
SELECT predicted, recipient, sender, level, n, n / sum(n) OVER (PARTITION BY level,
 CASE WHEN level > 1 THEN predicted END, CASE WHEN level > 2 THEN recipient END) AS share FROM counted"""
    out["sender_sketches"] = f"""WITH tokens AS ({out['token_set']}), {_MESSAGES}
SELECT predicted, count(*) AS n, count(DISTINCT token) AS exact, true AS near FROM tokens JOIN m USING (guid) GROUP BY predicted"""
    out["compared_runs"] = f"""WITH {_MESSAGES},
p AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS guid FROM labels),
b AS (SELECT rcpt, sender, predicted FROM m),
a AS (SELECT rcpt, sender, CASE WHEN p.guid IS NOT NULL THEN 'Legal' ELSE predicted END AS predicted FROM m LEFT JOIN p USING (guid)),
told AS (SELECT predicted, 1 AS gone, 0 AS come, 0 AS same FROM (FROM b EXCEPT ALL FROM a)
 UNION ALL SELECT predicted, 0, 1, 0 FROM (FROM a EXCEPT ALL FROM b)
 UNION ALL SELECT predicted, 0, 0, 1 FROM (FROM a INTERSECT ALL FROM b))
SELECT predicted, sum(gone)::BIGINT AS gone, sum(come)::BIGINT AS come, sum(same)::BIGINT AS same FROM told GROUP BY predicted"""
    out["user_prompt"] = f"WITH {_MESSAGES} SELECT guid, {_PROMPT} AS prompt FROM m"
    out["prompt_terms"] = f"WITH {_PART}, {_prompt_lines('part_all')} SELECT cat_no, code, line FROM lines"
    out["context_block"] = f"WITH {_PART}, {_CUSTOMER}, {_context('part_all', 'cust_labelled')} SELECT context FROM ctx"
    out["full_prompts"] = f"WITH {_ASKED} SELECT guid, prompt FROM asked"
    out["predict_stub"] = f"WITH {_ANSWERED} SELECT guid, raw, error FROM answered"
    out["predict_by_sender"] = f"""WITH {_MESSAGES}, asked AS (
SELECT guid, sender AS organisation, length({_PROMPT}) AS n FROM m)
SELECT organisation, guid,
 CASE WHEN organisation NOT LIKE 'src7@%' AND n % 13 <> 0 THEN organisation || ' ' || (n % 7) END AS raw,
 CASE WHEN organisation LIKE 'src7@%' THEN 'no predictor of ' || organisation
  WHEN n % 13 = 0 THEN 'no answer' END AS error FROM asked"""
    out["failed_predictions"] = f"WITH {_ANSWERED} SELECT guid, error FROM answered WHERE error IS NOT NULL"
    out["run_totals"] = f"WITH {_ANSWERED} SELECT count(raw) AS predicted, count(error) AS errors FROM answered"
    out["intent_distribution"] = f"""WITH {_ANSWERED}, good AS (SELECT * FROM answered WHERE error IS NULL), {_parsed('good')}
SELECT predicted_code, count(*) AS n FROM parsed GROUP BY predicted_code"""
    out["parse_responses"] = f"""WITH {_INT}, answers AS (
SELECT CAST(doc_id AS VARCHAR) AS guid, {fixtures.RESPONSE} AS raw FROM documents), {_parsed('answers')}
SELECT guid, predicted_intent, predicted_code FROM parsed"""
    out["parse_fallback"] = f"""WITH {_INT}, answers AS (
SELECT CAST(doc_id AS VARCHAR) AS guid, {fixtures.FALLBACK_RESPONSE} AS raw FROM documents),
found AS (SELECT guid, regexp_extract(raw, '\\{{[^{{}}]+\\}}') AS part FROM answers),
listed AS (SELECT guid, CASE WHEN json_valid(part) AND json_type(part, '$.intent_codes') = 'ARRAY'
 THEN json_extract_string(part, '$.intent_codes[*]') ELSE [] END AS cs FROM found),
codes AS (SELECT list(DISTINCT intent_code) AS ok FROM labelled),
kept AS (SELECT guid, list_filter(cs, lambda c: list_contains(ok, c)) AS cs FROM listed, codes)
SELECT guid, CASE WHEN len(cs) = 0 THEN 'Unclassified' ELSE array_to_string(cs, ',') END AS final_intents FROM kept"""
    return out
