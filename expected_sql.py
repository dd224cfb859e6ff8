"""DuckDB SQL that must return what the registered queries return."""

from __future__ import annotations

from ticketlens.sources.sample_tables import NOW

# --- metric queries ----------------------------------------------------------

TICKETS = f"""
WITH updates AS (
  SELECT l_orderkey, max(l_shipdate) AS updated FROM lineitem GROUP BY l_orderkey
), base AS (
  SELECT o_orderkey AS ticket_id, o_orderdate AS created, u.updated,
    strftime(o_orderdate, '%Y-%m-%d') AS day,
    CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'In Progress'
      ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'PENDEINTE CLIENTE' ELSE 'PENDIENTE CLIENTE' END
    END AS status,
    o_orderpriority AS tipo, c_name AS reporter, n_name AS agencia,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN u.updated END AS resolution
  FROM orders
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN updates u ON l_orderkey = o_orderkey
), spans AS (
  SELECT *, coalesce(resolution, CASE WHEN status = 'Done' THEN updated END) AS effective
  FROM base
), raw_hours AS (
  SELECT *,
    (epoch_us(effective) - epoch_us(created)) / 3.6e9 AS r,
    (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created)) / 3.6e9 AS a,
    (epoch_us(updated) - epoch_us(created)) / 3.6e9 AS u
  FROM spans
), tickets AS (
  SELECT *, strftime(effective, '%Y-%m-%d') AS resolved_day,
    CASE WHEN r >= 0 THEN r END AS resolution_hours,
    CASE WHEN status <> 'Done' AND a >= 0 THEN a END AS aging,
    CASE WHEN u >= 0 THEN u END AS touch
  FROM raw_hours
)
"""

BUCKET = """CASE WHEN aging < 24 THEN '0-24h' WHEN aging < 48 THEN '24-48h'
  WHEN aging < 72 THEN '48-72h' WHEN aging < 168 THEN '72h-7d' ELSE '7d+' END"""
LABELS = "(VALUES ('0-24h'), ('24-48h'), ('48-72h'), ('72h-7d'), ('7d+')) AS labels(bucket)"
PENDING = "(status = 'PENDIENTE CLIENTE' OR status = 'PENDEINTE CLIENTE')"


def _counts(column: str, name: str, top: int | None = None) -> str:
    limit = f"ORDER BY count DESC, {column} LIMIT {top}" if top else ""
    return (
        f'SELECT {column} AS "{name}", CAST(count(*) AS BIGINT) AS count '
        f"FROM tickets GROUP BY {column} {limit}"
    )


def _buckets(condition: str) -> str:
    return f"""SELECT bucket AS aging_bucket, CAST(count(aging) AS BIGINT) AS count
      FROM {LABELS} LEFT JOIN (SELECT * FROM tickets WHERE aging IS NOT NULL AND {condition})
      ON bucket = {BUCKET} GROUP BY bucket"""


KPIS = """SELECT CAST(count(*) AS BIGINT) AS total_tickets,
    CAST(count(*) FILTER (status <> 'Done') AS BIGINT) AS open_tickets,
    round(count(*) FILTER (status = 'Done') / count(*) * 100, 2) AS pct_done,
    round(count(*) / count(DISTINCT day), 2) AS avg_tickets_day,
    (SELECT tipo FROM tickets GROUP BY tipo ORDER BY count(*) DESC, tipo LIMIT 1) AS top_tipo,
    (SELECT agencia FROM tickets GROUP BY agencia ORDER BY count(*) DESC, agencia LIMIT 1)
      AS top_agencia
    FROM tickets"""
SLA = """SELECT round(count(*) FILTER (resolution_hours <= 48) / count(*) * 100, 2) AS sla_pct,
    CAST(count(*) AS BIGINT) AS resolved_count,
    CAST(count(*) FILTER (resolution_hours <= 48) AS BIGINT) AS within_sla_count
    FROM tickets WHERE resolution_hours IS NOT NULL"""
DAILY = """SELECT CAST(day AS DATE) AS "Date", tickets,
    round(avg(tickets) OVER (ORDER BY day ROWS 6 PRECEDING), 6) AS rolling_7d
    FROM (SELECT day, CAST(count(*) AS BIGINT) AS tickets FROM tickets GROUP BY day)"""
BY_RESOLVED_DAY = """SELECT CAST(resolved_day AS DATE) AS "ResolvedDate",
    round(avg(resolution_hours), 6) AS avg_resolution_time_hours
    FROM tickets WHERE resolution_hours IS NOT NULL GROUP BY resolved_day"""
BY_TIPO = """SELECT tipo AS "Tipo", round(avg(resolution_hours), 6) AS avg_resolution_time_hours
    FROM tickets WHERE resolution_hours IS NOT NULL GROUP BY tipo"""
DAY_BALANCE = """SELECT CAST(coalesce(c.day, r.day) AS DATE) AS "Date",
    CAST(coalesce(created, 0) AS BIGINT) AS created,
    CAST(coalesce(resolved, 0) AS BIGINT) AS resolved
    FROM (SELECT day, count(*) AS created FROM tickets GROUP BY day) c
    FULL JOIN (SELECT resolved_day AS day, count(*) AS resolved FROM tickets
      WHERE effective IS NOT NULL GROUP BY resolved_day) r ON c.day = r.day"""
HISTOGRAM = """SELECT CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * (hi - lo) / 30, 6) AS bin_start,
    round(lo + bin * (hi - lo) / 30, 6) AS bin_end, CAST(count(h) AS BIGINT) AS count
    FROM (SELECT min(resolution_hours) AS lo, max(resolution_hours) AS hi FROM tickets),
      range(1, 31) AS bins(bin)
    LEFT JOIN (SELECT resolution_hours AS h FROM tickets WHERE resolution_hours IS NOT NULL)
      ON least(CAST(floor(30 * (h - lo) / (hi - lo)) AS BIGINT) + 1, 30) = bin
    GROUP BY bin, lo, hi"""

METRICS = {
    "tickets_per_day": DAILY,
    "kpis": KPIS,
    "count_by_tipo": _counts("tipo", "Tipo"),
    "count_by_status": _counts("status", "Status"),
    "count_by_reporter_top15": _counts("reporter", "Reporter", 15),
    "count_by_agencia_top20": _counts("agencia", "Agencia", 20),
    "apply_filters": """SELECT ticket_id, created AS "Created_dt", status AS "Status",
        tipo AS "Tipo", reporter AS "Reporter", agencia AS "Agencia" FROM tickets
        WHERE created >= TIMESTAMP '1996-03-01' AND created <= TIMESTAMP '1998-06-30 23:59:59'
          AND status IN ('Done', 'PENDIENTE CLIENTE') AND tipo IN ('1-URGENT', '2-HIGH')
          AND agencia IN ('NATION_1', 'NATION_7', 'NATION_19')""",
    "facet_values": """SELECT DISTINCT 'Status' AS facet, status AS value FROM tickets
        UNION ALL SELECT DISTINCT 'Tipo', tipo FROM tickets
        UNION ALL SELECT DISTINCT 'Reporter', reporter FROM tickets
        UNION ALL SELECT DISTINCT 'Agencia', agencia FROM tickets""",
    "facet_values_reporter": 'SELECT DISTINCT reporter AS "Reporter" FROM tickets',
    "date_bounds": """SELECT CAST(min(created) AS DATE) AS min_date,
        CAST(max(created) AS DATE) AS max_date FROM tickets""",
    "time_metrics": """SELECT ticket_id, effective AS resolution_effective_dt,
        resolved_day AS "ResolvedDate", round(resolution_hours, 6) AS resolution_time_hours,
        round(aging, 6) AS aging_hours, round(touch, 6) AS touch_time_hours FROM tickets""",
    "avg_resolution_time_over_time": BY_RESOLVED_DAY,
    "resolution_time_distribution": """SELECT round(resolution_hours, 6) AS resolution_time_hours
        FROM tickets WHERE resolution_hours IS NOT NULL""",
    "resolution_time_histogram": HISTOGRAM,
    "resolution_time_by_tipo": BY_TIPO,
    "aging_buckets_open_tickets": _buckets("status <> 'Done'"),
    "client_pending_aging": f"""SELECT round(aging, 6) AS aging_hours, {BUCKET} AS aging_bucket
        FROM tickets WHERE aging IS NOT NULL AND {PENDING}""",
    "client_pending_aging_literal": f"""SELECT round(aging, 6) AS aging_hours, {BUCKET} AS aging_bucket
        FROM tickets WHERE aging IS NOT NULL AND status = 'PENDEINTE CLIENTE'""",
    "client_pending_aging_buckets": _buckets(PENDING),
    "created_vs_resolved_per_day": DAY_BALANCE,
    "sla_compliance": SLA,
}


def _parts(name: str, item: str, amounts: list[str], sql: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}.{amount}' AS table_name, CAST({item} AS VARCHAR) AS item, "
        f"round(CAST({amount} AS DOUBLE), 6) AS amount FROM ({sql})"
        for amount in amounts
    )


MERGED_REPORT = " UNION ALL ".join(
    [
        _parts("tickets_per_day", '"Date"', ["tickets", "rolling_7d"], DAILY),
        _parts("count_by_tipo", '"Tipo"', ["count"], _counts("tipo", "Tipo")),
        _parts("count_by_reporter", '"Reporter"', ["count"], _counts("reporter", "Reporter", 15)),
        _parts("count_by_status", '"Status"', ["count"], _counts("status", "Status")),
        _parts("count_by_agencia", '"Agencia"', ["count"], _counts("agencia", "Agencia", 20)),
        _parts("client_pending_aging_buckets", "aging_bucket", ["count"], _buckets(PENDING)),
        _parts(
            "avg_resolution_time_over_time",
            '"ResolvedDate"',
            ["avg_resolution_time_hours"],
            BY_RESOLVED_DAY,
        ),
        _parts("resolution_time_by_tipo", '"Tipo"', ["avg_resolution_time_hours"], BY_TIPO),
        _parts(
            "aging_buckets_open_tickets",
            "aging_bucket",
            ["count"],
            _buckets("status <> 'Done'"),
        ),
        _parts("created_vs_resolved_per_day", '"Date"', ["created", "resolved"], DAY_BALANCE),
        _parts(
            "kpis",
            "top_tipo || ' ' || top_agencia",
            ["total_tickets", "open_tickets", "pct_done", "avg_tickets_day"],
            KPIS,
        ),
        _parts("sla_compliance", "''", ["sla_pct", "resolved_count", "within_sla_count"], SLA),
    ]
)
REPORT = f"""{MERGED_REPORT} UNION ALL {
    _parts("resolution_time_histogram", "bin", ["count", "bin_start", "bin_end"], HISTOGRAM)
}"""

HOUR_BINS = """SELECT e.bin AS bin, count(t.resolution_hours) AS count FROM (
    SELECT *, lead(start, 1, 1000000000) OVER (ORDER BY start) AS until, row_number() OVER (ORDER BY start) AS bin
    FROM (SELECT unnest([0, 1, 2, 4, 8, 12, 24, 48, 72, 120, 168, 336, 720, 1440, 2160, 4320, 8760]) AS start)) e
  LEFT JOIN tickets t ON t.resolution_hours >= e.start AND t.resolution_hours < e.until GROUP BY e.bin"""

# --- ingest queries ----------------------------------------------------------


def _export(second_layout: bool) -> str:
    tipo = "CASE WHEN ticket_id % 7 <> 0 THEN tipo END"
    resolved = "CASE WHEN status = 'Done' THEN updated END" if second_layout else "NULL"
    branch = "agencia" if second_layout else "''"
    return f"""SELECT ticket_id, 'Ticket ' || ticket_id AS "Summary", {tipo} AS "Tipo",
        {branch} AS "Agencia", created AS "Created_dt",
        coalesce({resolved}, resolution) AS "Resolution_dt", updated AS "Last_Updated_dt",
        day AS "Date", strftime(coalesce({resolved}, resolution), '%Y-%m-%d') AS "ResolvedDate",
        strftime(created, '%a') AS "DayOfWeek" FROM tickets"""


INGEST = {
    "normalize_legacy_layout": _export(False),
    "normalize_second_layout": _export(True),
    "read_tickets_csv": _export(True),
    "fill_defaults": """SELECT ticket_id, '' AS issue_type, '' AS "Agencia",
        CASE WHEN ticket_id % 7 <> 0 THEN tipo ELSE 'Unknown' END AS "Tipo",
        coalesce(strftime(resolution, '%Y-%m-%d %H:%M'), '') AS "Resolution",
        '' AS "Description" FROM tickets""",
    "write_tickets": """SELECT ticket_id, created AS "Created_dt", status AS "Status",
        CAST(year(created) * 100 + month(created) AS INTEGER) AS created_month FROM tickets
        WHERE created >= TIMESTAMP '1997-01-15' AND created <= TIMESTAMP '1997-03-10 23:59:59'""",
}

PARSE = """SELECT event_id, CASE event_id % 6
    WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN ts WHEN 2 THEN date_trunc('minute', ts)
    WHEN 3 THEN date_trunc('minute', ts) WHEN 4 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END
    AS parsed FROM events"""

# --- text queries ------------------------------------------------------------


def _blank(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({text}, '{quoted}', ' ', 'gi')"


def _fold(text: str) -> str:
    return f"lower(strip_accents({text}))"


def _drop(text: str) -> str:
    words = "list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')"
    tail = f"array_to_string(list_slice({words}, 4, 1000000), ' ')"
    chunks = f"list_transform(regexp_split_to_array({text}, '[.!?\\n;:]+'), lambda s: {tail})"
    return f"array_to_string(list_filter({chunks}, lambda c: c <> ''), ' ')"


# --- Fixed values: markup patterns, greetings and image words ------------------
EXT = "(?:png|jpg|jpeg|gif|webp|svg|bmp|heic)"
STEP_PATTERNS = {
    "strip_smart_links": r"\[[^\]]+\|https?://[^\]|]+(?:\|smart-link)?\]",
    "strip_image_embeds": rf"![^!\n]*\.{EXT}(?:\|[^!\n]*)?!",
    "strip_markdown_images": r"!\[[^\]]*\]\([^)]+\)",
    "strip_img_tags": r"<img\b[^>]*>",
    "strip_image_filenames": rf"\b[\w\-.]+\.{EXT}\b",
    "strip_image_attrs": r"""\b(?:alt|width|height)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s,;]+)""",
    "strip_urls": r"(?:https?://\S+|www\.\S+)",
    "strip_image_words": r"\b(?:image|imagen|png|jpg|jpeg|gif|webp|svg|bmp|heic)\b",
}
GREETINGS = (
    r"\b(?:buen dia|buenos dias|hola|estimados|estimado|cordial saludo|saludos|"
    r"buenas tardes|buenas noches)\b[:,;\-\s]*"
)

MARKED_UP = """(SELECT doc_id AS ticket_id, 'Hola, [' || lang || '|https://example.org/' || doc_id
    || '|smart-link] ' || text || ' !captura ' || doc_id || '.png|thumbnail! luego ![una foto](foto'
    || doc_id || '.jpg) y <img src=''' || doc_id || '''> con Foto-' || doc_id || '.GIF o width = '
    || n_chars || ' height="10" en WWW.example.org/t/' || doc_id
    || ' la Imagen que dice: Buenos dias; ' || source AS text FROM documents)"""


def _cleaned(text: str) -> str:
    for pattern in STEP_PATTERNS.values():
        text = _blank(text, pattern)
    return _drop(_blank(_fold(text), GREETINGS))


DOCS = f"""
WITH cleaned AS (
  SELECT doc_id AS ticket_id, lang AS tipo, source AS agencia, text AS description,
    source || ' ' || lang || ' ' || doc_id AS summary,
    {_cleaned("text")} AS clean FROM documents
), eligible AS (SELECT * FROM cleaned WHERE length(clean) >= 20)
"""

# --- Fixed values: words that never become terms -----------------------------
STOPWORDS = [
    "de", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o", "u",
    "a", "ante", "con", "contra", "desde", "en", "entre", "hacia", "hasta", "para",
    "por", "sin", "sobre", "tras", "que", "se", "su", "sus", "al", "del", "lo",
    "le", "les", "como", "ya", "si", "no", "mas", "muy", "favor", "gracias",
    "buen", "buenos", "buenas", "dia", "dias", "tarde", "tardes", "noche", "noches",
    "estimado", "estimados", "adjunto", "adjunta", "quedo", "pendiente", "cordial",
    "saludo", "saludos", "hola", "ticket", "jira",
]

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: regexp_full_match(w, '[a-z][a-z0-9_]{{2,}}') AND NOT list_contains({STOP}, w))"
    )


def _ngrams(tokens: str) -> str:
    pairs = f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"
    triples = (
        f"list_transform(range(1, len({tokens}) - 1), lambda i: "
        f"{tokens}[i] || ' ' || {tokens}[i + 1] || ' ' || {tokens}[i + 2])"
    )
    return f"list_concat(list_concat({tokens}, {pairs}), {triples})"


def _step(text: str) -> str:
    return f"SELECT ticket_id, {text} AS text FROM {MARKED_UP}"


# Fixed value: image and markup words
NOISE = "image|imagen|img|png|jpg|jpeg|gif|webp|svg|bmp|heic|alt|width|height"
TEXTS = {
    **{name: _step(_blank("text", p)) for name, p in STEP_PATTERNS.items()},
    "fold_text": _step(_fold("text")),
    "strip_greetings": _step(_blank("text", GREETINGS)),
    "drop_first_words": _step(_drop("text")),
    "clean_markup": _step(_cleaned("text")),
    "truncate_text": """SELECT doc_id AS ticket_id, CASE WHEN length(text) <= 350 THEN text
        ELSE regexp_replace(substring(text, 1, 349), '\\s+$', '') || '…' END AS text
        FROM documents""",
    "trim_lower": """SELECT doc_id AS ticket_id,
        lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text
        FROM documents""",
    "tokens": f"""SELECT ticket_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, ' ') AS tokens
        FROM (SELECT doc_id AS ticket_id, {_tokens("text")} AS t FROM documents)""",
    "ngrams": f"""SELECT ticket_id, CAST(len(g) AS BIGINT) AS n, array_to_string(g, '|') AS terms
        FROM (SELECT ticket_id, {_ngrams("t")} AS g
          FROM (SELECT doc_id AS ticket_id, {_tokens("text")} AS t FROM documents))""",
    "noise_keywords": f"""SELECT word, CAST(count(*) AS BIGINT) AS count
        FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_\\-]+')) AS word
          FROM {MARKED_UP})
        WHERE regexp_matches(word, '(?:^|[\\s_-])(?:{NOISE})(?:$|[\\s_-])') GROUP BY word""",
}
CLEAN = """SELECT ticket_id, clean AS "Description_clean",
    CAST(length(clean) AS INTEGER) AS "Description_clean_len",
    length(clean) >= 20 AS "NLP_Eligible" FROM cleaned"""

# --- theme queries -----------------------------------------------------------


def _tfidf(docs: str) -> str:
    """CTEs up to `weights` over the texts of `docs`."""
    return f"""
, tokenized AS (SELECT ticket_id, {_tokens("clean")} AS t FROM {docs}
), occurrences AS (SELECT ticket_id, unnest({_ngrams("t")}) AS term FROM tokenized
), counts AS (SELECT ticket_id, term, count(*) AS tf FROM occurrences GROUP BY ticket_id, term
), corpus AS (SELECT count(*) AS n FROM {docs}
), idf AS (
  SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), corpus
  WHERE df >= CASE WHEN n >= 80 THEN 2 ELSE 1 END AND (df <= 0.95 * n OR n <= 1)
), raw_weights AS (SELECT ticket_id, term, (1 + ln(tf)) * idf AS raw FROM counts JOIN idf USING (term)
), weights AS (
  SELECT ticket_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY ticket_id)) AS weight
  FROM raw_weights
)
"""


KEYWORDS = f"""
, sizes AS (SELECT theme_id, CAST(count(*) AS BIGINT) AS count FROM groups GROUP BY theme_id
), means AS (
  SELECT theme_id, term, round(sum(weight) / any_value(count), 12) AS mean_weight
  FROM weights JOIN groups USING (ticket_id) JOIN sizes USING (theme_id) GROUP BY theme_id, term
), heaviest AS (
  SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY mean_weight DESC, term) AS rank
  FROM means
), words AS (
  SELECT theme_id, coalesce(list(term ORDER BY rank) FILTER (mean_weight > 0
    AND NOT regexp_matches(term, '(?:^|[\\s_-])(?:{NOISE})(?:$|[\\s_-])')), []) AS kw
  FROM heaviest WHERE rank <= 12 GROUP BY theme_id
)
"""
LABEL = "CASE WHEN len(kw) > 0 THEN substring(array_to_string(kw[1:4], ', '), 1, 80) ELSE 'Tema general' END"

LANGUAGES = (
    DOCS + _tfidf("eligible") + ", groups AS (SELECT ticket_id, tipo AS theme_id FROM eligible)" + KEYWORDS
)

GIVEN = (
    DOCS
    + """
, groups AS (
  SELECT ticket_id, CAST(regexp_extract(agencia, '([0-9]+)$', 1) AS INTEGER) % 10 AS theme_id FROM eligible
), labelled AS (
  SELECT vec_id AS ticket_id, theme_id, embedding FROM embeddings JOIN groups ON vec_id = groups.ticket_id
), given AS (SELECT * FROM eligible)
"""
    + _tfidf("given")
    + KEYWORDS
    + """
, cells AS (
  SELECT ticket_id, theme_id, generate_subscripts(embedding, 1) AS i,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM labelled
), lengths AS (SELECT ticket_id, sqrt(sum(x * x)) AS len FROM cells GROUP BY ticket_id
), unit_cells AS (SELECT ticket_id, theme_id, i, x / len AS x FROM cells JOIN lengths USING (ticket_id)
), centers AS (SELECT theme_id, i, avg(x) AS c FROM unit_cells GROUP BY theme_id, i
), center_lengths AS (SELECT theme_id, sqrt(sum(c * c)) + 1e-12 AS len FROM centers GROUP BY theme_id
), sims AS (
  SELECT ticket_id, theme_id, sum(x * c) / any_value(len) AS sim
  FROM unit_cells JOIN centers USING (theme_id, i) JOIN center_lengths USING (theme_id)
  GROUP BY ticket_id, theme_id
), stats AS (
  SELECT theme_id, count(*) AS n, max(sim) AS best, quantile_cont(sim, 0.7) AS q
  FROM sims GROUP BY theme_id
), passing AS (
  SELECT * FROM sims JOIN stats USING (theme_id)
  WHERE n <= 3 OR best < 0.5 OR sim >= greatest(0.5, q, 0.78 * best)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY sim DESC, ticket_id) AS rank
  FROM passing
), reps AS (
  SELECT theme_id, ticket_id, CAST(rank AS INTEGER) AS representative_rank,
    round(sim, 6) AS representative_similarity
  FROM ranked WHERE rank <= 3
), top AS (SELECT * FROM sizes ORDER BY count DESC, theme_id LIMIT 10
), examples AS (
  SELECT theme_id, array_to_string(list(trim(summary, e' \\n') ORDER BY representative_rank)
    FILTER (summary <> ''), ' | ') AS example_summaries
  FROM reps JOIN given USING (ticket_id) GROUP BY theme_id
), themes AS (
"""
    + f"""
  SELECT theme_id, {LABEL} AS label, count, array_to_string(kw, ', ') AS keywords,
    coalesce(example_summaries, '') AS example_summaries
  FROM top JOIN words USING (theme_id) LEFT JOIN examples USING (theme_id)
), members AS (
  SELECT g.ticket_id, g.theme_id, summary AS "Summary", description AS "Description",
    clean AS "Description_clean", representative_rank, representative_similarity,
    CASE WHEN representative_rank IS NULL THEN NULL WHEN length(description) <= 350 THEN description
      ELSE regexp_replace(substring(description, 1, 349), '\\s+$', '') || '…' END
      AS "Description_trimmed"
  FROM given JOIN groups g USING (ticket_id) JOIN top USING (theme_id)
    LEFT JOIN reps ON reps.theme_id = g.theme_id AND reps.ticket_id = g.ticket_id
), first_tickets AS (
  SELECT theme_id, rank, nullif(s, '') AS s FROM (
    SELECT theme_id, trim("Summary", e' \\n') AS s,
      row_number() OVER (PARTITION BY theme_id ORDER BY ticket_id) AS rank FROM members)
), leads AS (
  SELECT theme_id, arg_min(s, rank) AS s FROM first_tickets
  WHERE rank <= 5 AND s IS NOT NULL GROUP BY theme_id
)
"""
)

THEMES = {
    "theme_coverage": DOCS
    + """SELECT CAST(count(*) AS BIGINT) AS total_descriptions,
        CAST(count(*) FILTER (length(clean) >= 20) AS BIGINT) AS eligible_descriptions,
        CAST(count(*) FILTER (length(clean) < 20) AS BIGINT) AS excluded_short_descriptions
        FROM cleaned""",
    "eligible_texts": DOCS + 'SELECT ticket_id, clean AS "Description_clean" FROM eligible',
    "tfidf": DOCS
    + _tfidf("eligible")
    + "SELECT ticket_id, term, round(weight, 6) AS weight FROM weights",
    "theme_term_weights": LANGUAGES
    + "SELECT theme_id, term, round(mean_weight, 6) AS mean_weight FROM means",
    "theme_keywords": LANGUAGES
    + f"SELECT theme_id, array_to_string(kw, ', ') AS keywords, {LABEL} AS label FROM words",
    "theme_sizes": GIVEN + "SELECT theme_id, count FROM sizes",
    "theme_representatives": GIVEN + "SELECT * FROM reps",
    "themes_table": GIVEN + "SELECT * FROM themes",
    "write_themes": GIVEN + "SELECT * FROM themes",
    "rank_themes": GIVEN
    + """SELECT theme_id, count,
        CAST(row_number() OVER (ORDER BY count DESC, theme_id) AS INTEGER) AS rank FROM top""",
    "ticket_themes": GIVEN + "SELECT * FROM members",
    "theme_example_sentences": GIVEN
    + """SELECT theme_id, CASE WHEN s IS NULL THEN label
        WHEN trim(ltrim(split_part(s, e'\\n', 1), '- ')) = '' THEN label
        ELSE 'Casos como: ' || trim(ltrim(split_part(s, e'\\n', 1), '- ')) || '.' END AS sentence
        FROM themes LEFT JOIN leads USING (theme_id)""",
    "top_theme_sentence": GIVEN
    + """SELECT 'El tema principal (' || count || ' tickets) trata sobre ''' || label
        || ''', con foco en ' || array_to_string(string_split(keywords, ', ')[1:3], ', ')
        || ' y casos como: ' || coalesce((SELECT array_to_string(list(s ORDER BY rank)[1:2], '; ')
          FROM first_tickets f WHERE f.theme_id = t.theme_id AND rank <= 3 AND s IS NOT NULL),
          'sin ejemplos destacados') || '.' AS sentence
        FROM themes t ORDER BY count DESC, theme_id LIMIT 1""",
    "semantic_vectors": """SELECT doc_id AS ticket_id, CAST(1 AS DOUBLE) AS own,
        CAST(0 AS DOUBLE) AS other FROM documents""",
    "text_cosines": DOCS
    + _tfidf("eligible")
    + """, widest AS (SELECT term FROM weights GROUP BY term ORDER BY count(*) DESC, term LIMIT 40
), few AS (SELECT ticket_id, term, weight FROM weights JOIN widest USING (term)
), norms AS (SELECT ticket_id, sqrt(sum(weight * weight)) AS norm FROM few GROUP BY ticket_id
), dots AS (
  SELECT a.ticket_id, sum(a.weight * b.weight) AS dot FROM few a
  JOIN few b ON b.ticket_id = a.ticket_id + 1 AND b.term = a.term GROUP BY a.ticket_id
)
SELECT e.ticket_id, round(coalesce(dot / (x.norm * y.norm), 0), 6) AS cosine, true AS same FROM eligible e
JOIN eligible f ON f.ticket_id = e.ticket_id + 1 LEFT JOIN dots ON dots.ticket_id = e.ticket_id
LEFT JOIN norms x ON x.ticket_id = e.ticket_id LEFT JOIN norms y ON y.ticket_id = f.ticket_id""",
    "build_themes": DOCS
    + """SELECT CAST(count(*) AS BIGINT) AS total_descriptions,
        CAST(count(*) FILTER (length(clean) >= 20) AS BIGINT) AS eligible_descriptions,
        CAST(count(*) FILTER (length(clean) < 20) AS BIGINT) AS excluded_short_descriptions,
        true AS k_in_range, true AS ranks_in_order,
        CAST(count(*) FILTER (length(clean) >= 20) AS BIGINT) AS tickets_in_themes,
        CAST(count(*) FILTER (length(clean) >= 20) AS BIGINT) AS ticket_rows,
        CAST(count(*) FILTER (length(clean) >= 20) AS BIGINT) AS tickets FROM cleaned""",
    "planted_themes": """SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 10 AS theme_group,
        CAST(count(*) AS BIGINT) AS count, min(doc_id) AS least_ticket FROM documents GROUP BY 1""",
}

EXPECTED: dict[str, str] = {
    **{name: TICKETS + sql for name, sql in METRICS.items()},
    "report_tables": TICKETS + REPORT,
    "report_by_month": f"{TICKETS}{MERGED_REPORT} UNION ALL {_parts('resolution_time_bins', 'bin', ['count'], HOUR_BINS)}",
    **{name: TICKETS + sql for name, sql in INGEST.items()},
    "parse_ticket_ts": PARSE,
    **TEXTS,
    "clean_description": DOCS + CLEAN,
    "prepare_tickets": DOCS
    + """, dated AS (
          SELECT *, CAST(DATE '2024-01-01' + CAST(ticket_id % 365 AS INTEGER) AS TIMESTAMP) AS created,
            CAST(DATE '2024-01-01' + CAST(ticket_id % 365 + ticket_id % 9 AS INTEGER) AS TIMESTAMP) AS later
          FROM cleaned
        ), ended AS (
          SELECT *, CASE WHEN ticket_id % 3 = 0 OR ticket_id % 2 = 0 THEN later END AS effective FROM dated
        )
        SELECT ticket_id, strftime(created, '%Y-%m-%d') AS "Date", strftime(created, '%a') AS "DayOfWeek",
        strftime(effective, '%Y-%m-%d') AS "ResolvedDate",
        description AS "Description", clean AS "Description_clean",
        CAST(length(clean) AS INTEGER) AS "Description_clean_len", length(clean) >= 20 AS "NLP_Eligible",
        effective AS resolution_effective_dt,
        CAST(CASE WHEN effective IS NOT NULL THEN ticket_id % 9 * 24 END AS DOUBLE) AS resolution_time_hours,
        CAST(CASE WHEN ticket_id % 2 = 1 AND created <= TIMESTAMP '""" + NOW + """'
          THEN (epoch(TIMESTAMP '""" + NOW + """') - epoch(created)) / 3600 END AS DOUBLE) AS aging_hours,
        CAST(ticket_id % 9 * 24 AS DOUBLE) AS touch_time_hours FROM ended""",
    **THEMES,
}
