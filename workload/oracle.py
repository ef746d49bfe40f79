"""The workload in SQL, as an independent check."""

from __future__ import annotations

BLANKS = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
CJK = r"[\x{4e00}-\x{9fff}]+"

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


def query(needs: list[str], body: str, **extra: str) -> str:
    """``body`` behind the CTEs it needs, in order; ``extra`` are further CTEs after those."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in VIEWS[name][0]:
                visit(need)
            ordered.append(name)

    for name in needs:
        visit(name)
    ctes = [f"{name} AS (\n{VIEWS[name][1]}\n)" for name in ordered]
    ctes += [f"{name} AS (\n{sql}\n)" for name, sql in extra.items()]
    recursive = "RECURSIVE " if any(f"FROM {name} " in sql for name, sql in extra.items()) else ""
    head = f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else ""
    return head + body


# --- the derived tables ---------------------------------------------------------------------

view("raw_messages", [], """
WITH seen AS (
  SELECT conv_id, turn, role, text, conv_id % 3 AS s FROM conversations
  UNION ALL
  SELECT conv_id, turn, role, text, (conv_id + 1) % 3 AS s FROM conversations WHERE conv_id % 10 = 1
)
SELECT concat('acct', CAST(s AS VARCHAR)) AS session_name, 5000 + conv_id AS chat_id,
       turn + 1 AS message_id,
       CASE WHEN (conv_id + turn) % 13 = 12 THEN 'service' ELSE 'message' END AS kind,
       CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL
            WHEN (conv_id + turn) % 17 = 1 THEN '' ELSE text END AS text,
       CASE WHEN role = 'user' THEN 1000 + conv_id % 3
            WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 5000 + conv_id
            WHEN role = 'assistant' THEN 900000 + conv_id END AS from_user_id,
       CASE WHEN role = 'system' AND conv_id % 2 = 1 THEN 5000 + conv_id END AS from_channel_id,
       CAST(NULL AS BIGINT) AS from_chat_id,
       1704067200 + conv_id * 3600 + turn * 60 AS date
FROM seen""")

view("entities", [], """
SELECT DISTINCT 1000 + conv_id % 3 AS entity_id, 'user' AS kind, CAST(NULL AS VARCHAR) AS username,
       'Me' AS first_name, CAST(conv_id % 3 AS VARCHAR) AS last_name, CAST(NULL AS VARCHAR) AS title
FROM conversations
UNION ALL
SELECT DISTINCT 5000 + conv_id, 'user', concat('peer', CAST(conv_id AS VARCHAR)), 'Peer',
       CASE WHEN conv_id % 4 <> 0 THEN CAST(conv_id AS VARCHAR) END, CAST(NULL AS VARCHAR)
FROM conversations WHERE conv_id % 2 = 0
UNION ALL
SELECT DISTINCT 5000 + conv_id, 'channel', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
       CAST(NULL AS VARCHAR), concat('Group ', CAST(conv_id AS VARCHAR))
FROM conversations WHERE conv_id % 2 = 1
UNION ALL
SELECT DISTINCT 900000 + conv_id, 'user', CAST(NULL AS VARCHAR), 'Member', CAST(conv_id AS VARCHAR),
       CAST(NULL AS VARCHAR)
FROM conversations WHERE conv_id % 2 = 1""")

view("accounts", [], """
SELECT DISTINCT conv_id % 3 AS pos, concat('acct', CAST(conv_id % 3 AS VARCHAR)) AS name,
       1000 + conv_id % 3 AS telegram_id
FROM conversations""")

view("session_chats", [], """
SELECT DISTINCT concat('acct', CAST(conv_id % 3 AS VARCHAR)) AS session_name,
       CASE WHEN conv_id % 2 = 1 THEN concat('-100', lpad(CAST(5000 + conv_id AS VARCHAR), 10, '0'))
            WHEN conv_id % 4 = 0 THEN concat('@peer', CAST(conv_id AS VARCHAR))
            ELSE CAST(5000 + conv_id AS VARCHAR) END AS chat_ref
FROM conversations WHERE conv_id % 7 <> 6
UNION ALL
SELECT DISTINCT concat('acct', CAST((conv_id + 1) % 3 AS VARCHAR)),
       concat('-100', lpad(CAST(5000 + conv_id AS VARCHAR), 10, '0'))
FROM conversations WHERE conv_id % 10 = 1 AND conv_id % 7 <> 6
UNION ALL
SELECT DISTINCT concat('acct', CAST(conv_id % 3 AS VARCHAR)), '@nobody' FROM conversations""")

view("requests", [], """
SELECT * FROM (VALUES
  (1, 1000, 'the'), (2, 1001, 'que la'), (3, 1002, 'que-la'), (4, 9999, 'Me'),
  (5, 1001, 'group'), (6, 1000, 'zzznonexistent'), (7, 9999, 'the context:2,1 toggle_on:full'),
  (8, 1000, '/search der context:,3'), (9, 1000, '/start'), (10, 1002, '!!! ...'),
  (11, 1002, 'die context:3,x'), (12, 1000, '')
) AS t(request_id, user_id, raw_text)""")

view("turn_requests", [], """
SELECT conv_id * 1000 + turn AS request_id, 1000 + (conv_id + turn) % 4 AS user_id,
  CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL WHEN (conv_id + turn) % 17 = 1 THEN ''
  ELSE concat(
    CASE turn % 5 WHEN 1 THEN '/search ' WHEN 2 THEN '/start ' WHEN 3 THEN '/other ' ELSE '' END,
    text,
    CASE conv_id % 8
      WHEN 0 THEN concat(' context:', CAST(conv_id % 14 - 2 AS VARCHAR))
      WHEN 1 THEN concat(' context:', CAST(conv_id % 14 - 2 AS VARCHAR), ',', CAST(turn AS VARCHAR))
      WHEN 2 THEN concat(' context:,', CAST(conv_id % 14 - 2 AS VARCHAR))
      WHEN 3 THEN concat(' toggle_on:full context:', CAST(conv_id % 14 - 2 AS VARCHAR), ',')
      WHEN 4 THEN ' context:3,x toggle_on:full toggle_off:full'
      WHEN 5 THEN ' context: context:abc context:99999999999999999999999999999999999999999'
      WHEN 6 THEN concat(' context:1 context:+', CAST(turn AS VARCHAR), ',')
      ELSE '' END) END AS raw_text
FROM conversations""")

view("dm", [], """
SELECT concat(lang, ':', substr(source, 4), ':', CAST(doc_id AS VARCHAR)) AS id,
       CAST(substr(source, 4) AS BIGINT) AS chat_id, doc_id AS message_id, lang AS session_name, text,
       CAST(NULL AS BIGINT) AS sender_id, CAST(NULL AS VARCHAR) AS sender_name,
       source AS receiver_name, 1704067200 + doc_id * 60 AS date, source AS chat_title
FROM documents""")

view("mixed", ["dm"], """
SELECT * REPLACE (translate(lower(text), 'aeious', '今天气真好日') AS text) FROM dm""")

# --- resolving and enriching ----------------------------------------------------------------

view("resolution", ["session_chats", "entities"], r"""
WITH refs AS (
  SELECT *, coalesce(CAST(TRY_CAST(CASE WHEN regexp_matches(chat_ref, '^-100[0-9]{10,}$') THEN substr(chat_ref, 5)
                 WHEN regexp_matches(chat_ref, '^-[0-9]+$') THEN substr(chat_ref, 2)
                 WHEN regexp_matches(chat_ref, '^[0-9]+$') THEN chat_ref END AS BIGINT) AS VARCHAR),
                 concat('@', lower(ltrim(chat_ref, '@')))) AS key
  FROM session_chats),
keyed AS (
  SELECT CAST(entity_id AS VARCHAR) AS key, * FROM entities
  UNION ALL
  SELECT concat('@', lower(username)), * FROM entities WHERE username <> '')
SELECT r.session_name, r.chat_ref, k.entity_id AS chat_id,
       coalesce(nullif(k.title, ''), nullif(k.first_name, '')) AS chat_title, k.kind = 'user' AS is_private
FROM refs r LEFT JOIN keyed k USING (key)""")

view("chats", ["resolution"], """
SELECT DISTINCT session_name, chat_id, chat_title, is_private FROM resolution WHERE chat_id IS NOT NULL""")

view("people", ["entities"], """
SELECT entity_id, CASE WHEN coalesce(nullif(first_name, ''), nullif(title, '')) IS NOT NULL
  THEN concat(coalesce(nullif(first_name, ''), nullif(title, '')), coalesce(' ' || nullif(last_name, ''), '')) END
  AS display_name
FROM entities""")

view("text_rows", ["raw_messages"], """
SELECT * FROM raw_messages WHERE kind = 'message' AND text <> ''""")

view("with_sender", ["text_rows"], """
SELECT *, coalesce(nullif(from_user_id, 0), nullif(from_channel_id, 0), nullif(from_chat_id, 0)) AS sender_id
FROM text_rows""")

view("m", ["with_sender", "chats", "people", "accounts"], """
SELECT concat(w.session_name, ':', w.chat_id, ':', w.message_id) AS id, w.chat_id, w.message_id,
       w.session_name, w.text, w.sender_id, p.display_name AS sender_name,
       CASE WHEN c.is_private AND w.sender_id IS DISTINCT FROM a.telegram_id
            THEN o.display_name ELSE c.chat_title END AS receiver_name,
       coalesce(w.date, 0) AS date, c.chat_title
FROM with_sender w
JOIN chats c ON c.session_name = w.session_name AND c.chat_id = w.chat_id
JOIN accounts a ON a.name = w.session_name
LEFT JOIN people o ON o.entity_id = a.telegram_id
LEFT JOIN people p ON p.entity_id = w.sender_id""")

M_COLUMNS = (
    "id, chat_id, message_id, session_name, text, sender_id, sender_name, receiver_name, date, chat_title"
)

# --- text analysis --------------------------------------------------------------------------


def _words(x: str) -> str:
    return (
        f"regexp_extract_all(regexp_replace(lower({x}), '{CJK}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    )


def _runs(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{CJK}')"


def _pairs(r: str) -> str:
    return f"list_transform(range(1, length({r})), lambda i: substr({r}, i, 2))"


def index_tokens(x: str) -> str:
    runs = _runs(x)
    return (
        f"coalesce(list_concat({_words(x)}, "
        f"flatten(list_transform({runs}, lambda r: string_split(r, ''))), "
        f"flatten(list_transform({runs}, lambda r: {_pairs('r')}))), [])"
    )


def query_tokens(x: str) -> str:
    return (
        f"list_distinct(list_concat({_words(x)}, flatten(list_transform({_runs(x)}, "
        f"lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE {_pairs('r')} END))))"
    )


def lexicon_tokens(words: list[str]) -> tuple:
    """Index and query tokens with dictionary words of ideographs only, as functions of a text.

    A pattern of all words, longer ones first, takes the leftmost longest word.
    """
    ordered = sorted(words, key=lambda w: (-len(w), w))
    listed = "[" + ", ".join(f"'{w}'" for w in ordered) + "]"
    one = CJK.removesuffix("+")

    def cut(x: str) -> str:
        return f"regexp_extract_all(lower({x}), '{'|'.join([*ordered, one])}')"

    def inner(x: str) -> str:
        there = "CASE WHEN w <> q AND substr(w, i, length(q)) = q THEN q END"
        places = f"flatten(list_transform(range(1, length(w) + 1), lambda i: list_transform({listed}, lambda q: {there})))"
        return f"flatten(list_transform({cut(x)}, lambda w: list_filter({places}, lambda p: p IS NOT NULL)))"

    def index(x: str) -> str:
        return f"coalesce(list_concat({_words(x)}, {cut(x)}, {inner(x)}), [])"

    def query(x: str) -> str:
        return f"list_distinct(list_concat({_words(x)}, {cut(x)}))"

    return index, query


def split_parts(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANKS}'), lambda t: t <> '')"


def postings_ctes(src: str, tokens=index_tokens) -> dict[str, str]:
    """CTEs ``tok``, ``post``, ``fstat`` for a table of documents."""
    return {
        "tok": (
            f"SELECT id, session_name, chat_id, sender_id, {tokens('text')} AS tt, "
            f"{tokens('chat_title')} AS ct, "
            "CASE WHEN nullif(sender_name, '') IS NULL THEN [] ELSE [sender_name] END AS st "
            f"FROM {src}"
        ),
        "post": (
            "SELECT field, term, id, session_name, chat_id, sender_id, dl, count(*) AS tf FROM ("
            "SELECT id, session_name, chat_id, sender_id, 'text' AS field, len(tt) AS dl, unnest(tt) AS term FROM tok "
            "UNION ALL SELECT id, session_name, chat_id, sender_id, 'chat_title', len(ct), unnest(ct) FROM tok "
            "UNION ALL SELECT id, session_name, chat_id, sender_id, 'sender_name', len(st), unnest(st) FROM tok"
            ") GROUP BY ALL"
        ),
        "fstat": (
            "SELECT 'text' AS field, count(*) AS n_docs, CAST(coalesce(sum(len(tt)), 0) AS BIGINT) AS total_len FROM tok "
            "UNION ALL SELECT 'chat_title', count(*), CAST(coalesce(sum(len(ct)), 0) AS BIGINT) FROM tok "
            "UNION ALL SELECT 'sender_name', count(*), CAST(coalesce(sum(len(st)), 0) AS BIGINT) FROM tok"
        ),
    }


# --- searching ------------------------------------------------------------------------------


def search_ctes(
    src: str, limit: int, match: str = "any", analysis: tuple = (index_tokens, query_tokens)
) -> dict[str, str]:
    """CTEs up to ``hits`` for a CTE ``searches(search_id, query, scope_session_name, ...)``."""
    scope = " AND ".join(
        f"(s.scope_{c} IS NULL OR {{0}}.{c} = s.scope_{c})"
        for c in ("session_name", "chat_id", "sender_id")
    )
    no_scope = (
        "(s.scope_session_name IS NULL AND s.scope_chat_id IS NULL AND s.scope_sender_id IS NULL)"
    )
    ctes = postings_ctes(src, analysis[0])
    ctes["parts"] = (
        "SELECT * FROM (SELECT search_id, part_no, part, " + analysis[1]("part") + " AS toks FROM ("
        "SELECT search_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS part_no FROM ("
        f"SELECT search_id, {split_parts('query')} AS ps FROM searches))) WHERE len(toks) > 0"
    )
    ctes["clause"] = (
        "SELECT search_id, part_no, 'text' AS field, len(toks) AS n_terms, unnest(toks) AS term FROM parts "
        "UNION ALL SELECT search_id, part_no, 'chat_title', len(toks), unnest(toks) FROM parts "
        "UNION ALL SELECT search_id, part_no, 'sender_name', 1, part FROM parts"
    )
    ctes["dfreq"] = "SELECT field, term, count(*) AS df FROM post GROUP BY ALL"
    filtered = f" AND {scope.format('p')}"
    ctes["sat"] = (
        "SELECT c.search_id, c.part_no, c.field, p.id, sum(CAST(round("
        "ln(1 + (CAST(f.n_docs AS DOUBLE) - d.df + 0.5) / (CAST(d.df AS DOUBLE) + 0.5))"
        " * CAST(p.tf AS DOUBLE) * CAST(2.2 AS DOUBLE) / (CAST(p.tf AS DOUBLE) + CAST(1.2 AS DOUBLE) * "
        "(CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * p.dl / (CAST(f.total_len AS DOUBLE) / f.n_docs)))"
        " * 1000000) AS BIGINT)) AS micro "
        "FROM clause c JOIN post p ON p.field = c.field AND p.term = c.term "
        "JOIN dfreq d ON d.field = c.field AND d.term = c.term JOIN fstat f ON f.field = c.field "
        f"JOIN searches s ON s.search_id = c.search_id WHERE true{filtered} "
        "GROUP BY c.search_id, c.part_no, c.field, p.id, c.n_terms HAVING count(*) = c.n_terms"
    )
    every = (
        ""
        if match == "any"
        else " HAVING count(DISTINCT part_no) = (SELECT count(*) FROM parts q WHERE q.search_id = sat.search_id)"
    )
    ctes["scored"] = (
        f"SELECT search_id, id, CAST(sum(micro) AS BIGINT) AS micro FROM sat GROUP BY search_id, id{every}"
    )
    order = "PARTITION BY search_id ORDER BY micro DESC, id"
    ctes["best"] = f"SELECT * FROM scored QUALIFY row_number() OVER ({order}) <= {limit}"
    ctes["hits"] = (
        f"SELECT b.search_id, d.*, b.micro / CAST(1000000 AS DOUBLE) AS score FROM best b JOIN {src} d USING (id)"
    )
    return ctes


def fixed_searches(rows: list[tuple]) -> str:
    """``searches`` from rows (search_id, query[, session[, chat[, sender]]])."""

    def text(value) -> str:
        return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"

    values = []
    for row in rows:
        session, chat, sender = (*row[2:], None, None, None)[:3]
        values.append(
            f"({text(row[0])}, {text(row[1])}, CAST({text(session)} AS VARCHAR), "
            f"CAST({text(chat)} AS BIGINT), CAST({text(sender)} AS BIGINT))"
        )
    return (
        "SELECT * FROM (VALUES " + ", ".join(values) + ") AS t"
        "(search_id, query, scope_session_name, scope_chat_id, scope_sender_id)"
    )


HIT_COLUMNS = f"search_id, {M_COLUMNS}, score"


def search_sql(src: str, rows: list[tuple], limit: int = 20, match: str = "any"):
    return query(
        [src],
        f"SELECT {HIT_COLUMNS} FROM hits",
        searches=fixed_searches(rows),
        **search_ctes(src, limit, match),
    )


# --- requests -------------------------------------------------------------------------------

ROUTE = r"""CASE WHEN regexp_matches(raw_text, '^/start') THEN 'help'
  WHEN regexp_matches(raw_text, '^/search [^\n]+') THEN 'search'
  WHEN raw_text IS NULL OR raw_text = '' OR starts_with(raw_text, '/') THEN 'ignored'
  ELSE 'search' END"""


def routed(src: str) -> str:
    return (
        f"SELECT *, CASE WHEN route <> 'search' THEN NULL WHEN starts_with(raw_text, '/') "
        rf"THEN regexp_extract(raw_text, '^/search ([^\n]+)', 1) ELSE raw_text END AS query0 "
        f"FROM (SELECT *, {ROUTE} AS route FROM {src})"
    )


def _num(x: str) -> str:
    digits = f"regexp_replace({x}, '^[+-]?0*', '')"
    return (
        f"(CASE WHEN starts_with({x}, '-') OR {digits} = '' THEN 0 "
        f"WHEN length({digits}) > 2 THEN 10 ELSE least(TRY_CAST({digits} AS INTEGER), 10) END)"
    )


def parsed_ctes(src: str) -> dict[str, str]:
    """Flags by one recursion over the tokens of each routed request: CTE ``flagged``."""
    number = "regexp_matches({0}, '^[+-]?[0-9]+$')"
    left = "CASE WHEN contains(raw, ',') THEN split_part(raw, ',', 1) ELSE raw END"
    right = "CASE WHEN contains(raw, ',') THEN substr(raw, strpos(raw, ',') + 1) ELSE raw END"
    ok_l = f"(l = '' AND contains(raw, ',') OR {number.format('l')})"
    ok_r = f"(r = '' AND contains(raw, ',') OR {number.format('r')})"
    return {
        "routed": routed(src),
        "tokens": (
            f"SELECT request_id, {split_parts('query0')} AS toks FROM routed WHERE route = 'search'"
        ),
        "piece": (
            f"SELECT *, {ok_l} AS ok_l, {ok_l} AND {ok_r} AS ok_r FROM ("
            f"SELECT *, {left} AS l, {right} AS r FROM ("
            "SELECT request_id, i, tok, starts_with(tok, 'context:') AS ctx, substr(tok, 9) AS raw FROM ("
            "SELECT request_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tokens)))"
        ),
        "flags": (
            "SELECT request_id, "
            "arg_max(tok = 'toggle_on:full', i) FILTER (tok IN ('toggle_on:full', 'toggle_off:full')) AS full_text, "
            f"arg_max(CASE WHEN l = '' THEN 0 ELSE {_num('l')} END, i) FILTER (ctx AND ok_l) AS before, "
            f"arg_max(CASE WHEN r = '' THEN 0 ELSE {_num('r')} END, i) FILTER (ctx AND ok_r) AS after, "
            "string_agg(tok, ' ' ORDER BY i) FILTER (NOT (ctx AND ok_r) AND tok NOT IN ('toggle_on:full', 'toggle_off:full')) AS query "
            "FROM piece GROUP BY request_id"
        ),
        "flagged": (
            "SELECT t.request_id, q.user_id, coalesce(f.query, '') AS query, coalesce(f.full_text, false) AS full_text, "
            "coalesce(f.before, 0) AS before, coalesce(f.after, 0) AS after "
            "FROM tokens t JOIN routed q USING (request_id) LEFT JOIN flags f USING (request_id)"
        ),
    }


def prepared_ctes(src: str, unknown_user: str) -> dict[str, str]:
    allowed = "true" if unknown_user == "all" else "scope_session_name IS NOT NULL"
    return {
        **parsed_ctes(src),
        "scoped": (
            "SELECT f.*, (SELECT arg_min(name, pos) FROM accounts a WHERE a.telegram_id = f.user_id) "
            "AS scope_session_name FROM flagged f"
        ),
        "prepared": f"SELECT *, {allowed} AS allowed FROM scoped",
    }


def batch_ctes(src: str, unknown_user: str, limit: int = 10) -> dict[str, str]:
    """CTEs up to ``results`` for the requests table."""
    return {
        **prepared_ctes("requests", unknown_user),
        "searches": (
            "SELECT request_id AS search_id, query, scope_session_name, CAST(NULL AS BIGINT) AS scope_chat_id, "
            "CAST(NULL AS BIGINT) AS scope_sender_id FROM prepared WHERE allowed"
        ),
        **search_ctes(src, limit),
        "results": (
            f"SELECT search_id AS request_id, {M_COLUMNS}, score, "
            "row_number() OVER (PARTITION BY search_id ORDER BY date DESC, score DESC, id) AS rank, "
            "count(*) OVER (PARTITION BY search_id) AS n_results FROM hits"
        ),
    }


def around(src: str) -> str:
    """Rows around ``wanted(… session_name, chat_id, hit_message_id, before, after)``."""
    return (
        f"SELECT w.* EXCLUDE (session_name, chat_id), d.* FROM wanted w JOIN {src} d "
        "ON d.session_name = w.session_name AND d.chat_id = w.chat_id AND ("
        "d.message_id = w.hit_message_id "
        f"OR (SELECT count(*) FROM {src} x WHERE x.session_name = w.session_name AND x.chat_id = w.chat_id "
        "AND x.message_id > d.message_id AND x.message_id < w.hit_message_id) < w.before "
        "AND d.message_id < w.hit_message_id AND d.message_id >= 0 "
        f"OR (SELECT count(*) FROM {src} x WHERE x.session_name = w.session_name AND x.chat_id = w.chat_id "
        "AND x.message_id < d.message_id AND x.message_id > w.hit_message_id) < w.after "
        "AND d.message_id > w.hit_message_id)"
    )


def preview(full: str = "full_text") -> str:
    return (
        f"CASE WHEN NOT {full} AND length(coalesce(text, '')) > 200 "
        "THEN left(text, 197) || '...' ELSE coalesce(text, '') END"
    )


WHO = (
    "CASE WHEN coalesce(nullif(sender_name, ''), 'Unknown') = "
    "coalesce(nullif(receiver_name, ''), nullif(chat_title, ''), 'Unknown') "
    "THEN coalesce(nullif(sender_name, ''), 'Unknown') "
    "ELSE coalesce(nullif(sender_name, ''), 'Unknown') || ' → ' || "
    "coalesce(nullif(receiver_name, ''), nullif(chat_title, ''), 'Unknown') END"
)
DATE_TEXT = "strftime(to_timestamp(date) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M')"


def response_ctes(src: str, unknown_user: str) -> dict[str, str]:
    """CTEs up to ``bodies``."""
    return {
        **batch_ctes(src, unknown_user),
        "wanted": (
            "SELECT r.request_id, r.rank, r.n_results, r.session_name, r.chat_id, "
            "r.message_id AS hit_message_id, p.before, p.after, p.full_text "
            "FROM results r JOIN prepared p USING (request_id)"
        ),
        "near": around(src),
        "lined": (
            "SELECT request_id, rank, n_results, message_id, hit_message_id, "
            f"CASE WHEN message_id = hit_message_id THEN '🎯 ' || {DATE_TEXT} || chr(10) || '👤 ' || {WHO} "
            f"|| chr(10) || chr(10) || {preview()} || chr(10) "
            "ELSE '  ' || CASE WHEN message_id < hit_message_id THEN '⬆️' ELSE '⬇️' END || ' ' || "
            f"{DATE_TEXT} || ' ' || coalesce(nullif(sender_name, ''), 'Unknown') || ': ' || {preview()} || chr(10) END AS line "
            "FROM near"
        ),
        "blocks": (
            "SELECT request_id, rank, n_results, string_agg(line, '' ORDER BY message_id) || "
            "CASE WHEN rank < n_results THEN chr(10) || '════════ ' || rank || '/' || n_results "
            "|| ' ════════' || chr(10) || chr(10) ELSE '' END AS block "
            "FROM lined GROUP BY request_id, rank, n_results"
        ),
        "found": (
            "SELECT request_id, n_results, string_agg(block, '' ORDER BY rank) AS found FROM blocks GROUP BY ALL"
        ),
        "bodies": (
            "SELECT p.request_id, coalesce(n_results, 0) AS n_results, "
            "coalesce('🔍 Found ' || n_results || ' results for: ' || query || chr(10) || chr(10) || found, "
            "'No results found.') AS body FROM prepared p LEFT JOIN found USING (request_id)"
        ),
    }


def chunk_ctes(size: int) -> dict[str, str]:
    """CTE ``chunked(request_id, chunks)`` from ``bodies``, one line at a time."""
    cut = f"list_transform(range(0, greatest(1, (length(line) + {size - 1}) // {size})), lambda k: substr(line, k * {size} + 1, {size}))"
    return {
        "texts": "SELECT request_id, body, string_split(body, chr(10)) AS ls FROM bodies",
        "fold": (
            "SELECT request_id, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM texts UNION ALL "
            "SELECT request_id, i, CASE WHEN fits THEN done ELSE list_concat(flushed, cut[1:len(cut) - 1]) END, "
            "CASE WHEN fits THEN joined ELSE cut[-1] END FROM ("
            f"SELECT *, length(joined) <= {size} AS fits, CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END AS flushed, "
            f"{cut} AS cut FROM ("
            "SELECT f.request_id, f.i + 1 AS i, f.done, f.cur, t.ls[f.i + 1] AS line, "
            "CASE WHEN f.cur = '' THEN t.ls[f.i + 1] ELSE f.cur || chr(10) || t.ls[f.i + 1] END AS joined "
            "FROM fold f JOIN texts t USING (request_id) WHERE f.i < len(t.ls)))"
        ),
        "chunked": (
            f"SELECT t.request_id, CASE WHEN length(t.body) <= {size} THEN [t.body] "
            "WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END AS chunks "
            "FROM texts t JOIN fold f ON f.request_id = t.request_id AND f.i = len(t.ls)"
        ),
    }
