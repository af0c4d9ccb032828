"""SQL for DuckDB: the fixtures and the functions, stated a second time."""

from __future__ import annotations

from listingflow import vocabulary as V
from listingflow.catalog.core import AS_OF, YEAR
from listingflow.catalog.fixtures import ELIGIBILITY
from listingflow.schema import DEFAULTS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


def clean_text(c: str) -> str:
    return f"trim(translate(coalesce({c}, ''), '''\"', ''), E' \\t\\n\\r')"


def clean_amount(c: str) -> str:
    words = "|".join(V.NON_AMOUNT_WORDS)
    bare = f"translate({c}, {quoted(V.CURRENCY_SYMBOLS + ',')}, '')"
    return f"trim(regexp_replace(regexp_replace({bare}, '(?i)\\b({words})\\b', '', 'g'), " \
        "'\\s+', ' ', 'g'))"


def award(c: str) -> str:
    number = f"regexp_extract({clean_amount(c)}, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1)"
    return f"coalesce(try_cast(nullif({number}, '') AS DOUBLE), 0)"


def runs(c: str) -> str:
    return f"regexp_extract_all(replace({c}, ',', ''), '\\d+')"


def low_award(c: str) -> str:
    return f"try_cast({runs(c)}[1] AS DOUBLE)"


def high_award(c: str) -> str:
    return f"coalesce(try_cast({runs(c)}[2] AS DOUBLE), {low_award(c)})"


def format_deadline(c: str) -> str:
    names = [f"{m.lower()}|{m[:3].lower()}" for m in V.MONTHS]
    names[8] = "september|sept?"
    cases = [f"WHEN {c} = '' OR contains(lower({c}), 'no deadline') OR "
             f"contains(lower({c}), 'rolling') OR regexp_matches({c}, '\\d{{4}}') THEN {c}"]
    for n in names:
        p = f"'(?i)({n})\\s+(\\d{{1,2}})'"
        cases.append(f"WHEN regexp_matches({c}, {p}) THEN regexp_extract({c}, {p}, 1) || ' ' || "
                     f"regexp_extract({c}, {p}, 2) || ', {YEAR}'")
    cases.append(f"WHEN regexp_matches(trim({c}), '(?i)^({'|'.join(names)})$') "
                 f"THEN trim({c}) || ', {YEAR}'")
    slash = "'^(\\d{1,2})/(\\d{1,2})$'"
    month = f"try_cast(regexp_extract({c}, {slash}, 1) AS INT)"
    day = f"try_cast(regexp_extract({c}, {slash}, 2) AS INT)"
    listed = ", ".join(map(quoted, V.MONTHS))
    cases.append(f"WHEN {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31 THEN "
                 f"([{listed}])[{month}] || ' ' || {day} || ', {YEAR}'")
    return f"(CASE {' '.join(cases)} ELSE {c} END)"


def parse_deadline(c: str) -> str:
    formats = "['%Y-%m-%d', '%B %-d, %Y', '%b %-d, %Y', '%-m/%-d/%Y', '%B, %Y', '%b, %Y']"
    return f"CAST(try_strptime(trim({c}), {formats}) AS DATE)"


def expired(c: str, mode: str = "end_of_day") -> str:
    day = f"DATE '{AS_OF}'"
    if mode == "instant":
        return f"coalesce({parse_deadline(c)} < TIMESTAMP '{AS_OF} 00:00:00', false)"
    if mode == "sql_view":
        return f"NOT ({c} IS NULL OR {c} = '' OR {any_of(f'lower({c})', V.OPEN_ENDED_VIEW)} " \
            f"OR coalesce({parse_deadline(c)} > {day}, false))"
    return f"(NOT {any_of(f'lower({c})', V.OPEN_ENDED)} AND " \
        f"coalesce({parse_deadline(c)} < {day}, false))"


def target_label(c: str) -> str:
    merit = any_of(f"lower({c})", V.MERIT_PHRASES)
    need = any_of(f"lower({c})", V.NEED_PHRASES)
    return f"(CASE WHEN {merit} AND {need} THEN 'Both' WHEN {merit} THEN 'Merit' " \
        f"WHEN {need} THEN 'Need' ELSE 'Not specified' END)"


def target_type(c: str) -> str:
    return f"(CASE {target_label(c)} WHEN 'Merit' THEN 'merit' WHEN 'Need' THEN 'need' " \
        "ELSE 'both' END)"


def tags(c: str, rules: dict) -> str:
    parts = []
    for tag, (words, guards) in rules.items():
        test = any_of(f"lower({c})", words)
        if guards:
            test += f" AND NOT {any_of(f'lower({c})', guards)}"
        parts.append(f"CASE WHEN {test} THEN {quoted(tag)} END")
    return f"concat_ws(', ', {', '.join(parts)})"


def levels(c: str) -> str:
    return tags(c, V.ACADEMIC_LEVELS)


def ethnicities(c: str) -> str:
    return tags(c, V.ETHNICITIES)


def first_of(c: str, rules) -> str:
    cases = " ".join(f"WHEN {any_of(c, words)} THEN {quoted(label)}" for label, words in rules)
    return f"(CASE {cases} END)"


def gender(c: str) -> str:
    return first_of(f"lower({c})", V.EXPLICIT_GENDERS)


def strip_phrases(c: str) -> str:
    out = c
    for phrase in V.REDUNDANT_PHRASES:
        out = f"regexp_replace({out}, '(?i){phrase}', '', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def truncate(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) > {n} THEN trim(substr({c}, 1, {n - 3})) || '...' ELSE {c} END)"


def listing_id(name: str = "name", org: str = "organization", deadline: str = "deadline") -> str:
    return f"md5({name} || '-' || {org} || '-' || {deadline})"


def short_id(name: str, org: str) -> str:
    return f"substr(md5(lower({name} || '-' || coalesce(nullif({org}, ''), 'Unknown'))), 1, 16)"


def first_row(source: str, key: str, order: str = "src_seq") -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {key} " \
        f"ORDER BY {order}) = 1"


_DEADLINE = """CASE o_orderkey % 9
    WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%b %-d, %Y')
    WHEN 2 THEN month(o_orderdate) || '/' || day(o_orderdate)
    WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN 'Rolling' WHEN 5 THEN ''
    WHEN 6 THEN 'No deadline specified' WHEN 7 THEN 'Various deadlines'
    ELSE strftime(o_orderdate, '%B %-d') END"""
_TOTAL = "CAST(floor(o_totalprice) AS BIGINT)"
_THOUSANDS = "CAST(floor(o_totalprice / 1000) AS BIGINT)"
_AMOUNT = f"""CASE o_orderkey % 6 WHEN 0 THEN '$' || {_TOTAL}
    WHEN 1 THEN '$' || {_THOUSANDS} || ',000 - $' || ({_THOUSANDS} + 1) || ',000'
    WHEN 2 THEN 'Amount varies' WHEN 3 THEN '' WHEN 4 THEN 'up to €' || {_TOTAL} || '.50'
    ELSE 'TBD' END"""
_NEEDS = "CASE substr(o_orderpriority, 1, 1) " + " ".join(
    f"WHEN '{k}' THEN {quoted(v)}" for k, v in ELIGIBILITY.items()) + " END"

RAW = f"""raw AS (SELECT o_orderkey AS src_seq,
  'Award ' || (o_custkey % 97) || CASE WHEN o_orderkey % 3 = 0 THEN ' FUND' ELSE ' Fund' END
    AS name,
  {_DEADLINE} AS deadline, {_AMOUNT} AS amount, {_NEEDS} AS eligibility,
  o_orderdate AS created_at, o_orderstatus AS status, o_custkey AS user_id,
  'https://listings.example.org/a/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Org ' || c_mktsegment END AS organization,
  c_mktsegment AS site
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

LISTINGS = f"""{RAW},
listings AS (SELECT {listing_id()} AS listing_id, name, deadline, url,
  'Offered by ' || organization AS description, eligibility, organization,
  {levels('eligibility')} AS academic_level, {target_type('eligibility')} AS target_type,
  {ethnicities('eligibility')} AS ethnicity, {gender('eligibility')} AS gender,
  coalesce({low_award('amount')}, 0) AS min_award, {award('amount')} AS max_award,
  {any_of('lower(eligibility)', V.RENEWABLE_WORDS['table'])} AS renewable, 'US' AS country,
  status <> 'F' AS is_active, 'source-' || status AS source,
  created_at, created_at AS updated_at, src_seq FROM raw)"""

JOB_EVENTS = """job_events AS (SELECT event_id,
  'job-' || user_id || strftime(ts, '-%Y-%m-%d') AS job_id, strftime(ts, '%Y-%m-%d') AS run_day,
  ts AS event_ts,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
    WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CAST(floor(value) AS BIGINT) AS records_found, CAST(floor(value) AS BIGINT) AS records_processed,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(floor(value) / 2) AS BIGINT) END
    AS records_inserted,
  CASE WHEN event_type = 'error' THEN 0
    ELSE CAST(floor(value) - floor(floor(value) / 2) AS BIGINT) END AS records_updated,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Request timeout'
    WHEN 1 THEN 'ThrottlingException: Rate exceeded' ELSE 'Unexpected end of JSON' END END
    AS message FROM events)"""

APPLICATIONS = f"""{RAW}, applications AS (SELECT src_seq AS id, user_id,
  {listing_id()} AS listing_id, organization,
  CASE WHEN status = 'P' THEN 'draft' WHEN status = 'O' THEN 'submitted'
    WHEN user_id % 3 = 0 THEN 'approved' WHEN user_id % 3 = 1 THEN 'rejected'
    ELSE 'withdrawn' END AS status, created_at AS submitted_at FROM raw)"""

SITES = """sites AS (SELECT s_name AS site, 'https://site-' || s_suppkey || '.example.org' AS url,
  (['api', 'crawl', 'search', 'discovery'])[s_nationkey % 4 + 1] AS type,
  CASE WHEN s_acctbal < 8000 THEN s_acctbal > 0 END AS enabled, s_nationkey, s_acctbal
  FROM supplier)"""
SITE_TERMS = """terms AS (SELECT site, s_nationkey, 0 AS pos,
    'awards nation ' || s_nationkey AS term FROM sites
  UNION ALL SELECT site, s_nationkey, 1, 'grants nation ' || s_nationkey FROM sites
  UNION ALL SELECT site, s_nationkey, 2, 'funds nation ' || s_nationkey FROM sites
    WHERE s_acctbal > 5000)"""

FETCHED = """fetched AS (SELECT page_id, 'scraper-' || (page_id % 3) AS scraper, url,
  TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 120 AS INT)) AS fetched_at, html FROM pages)"""

DETAILS = """details AS (SELECT 'https://listings.example.org/a/' || l_orderkey AS url,
  CASE WHEN max(l_linenumber) > 3 THEN 'Detail org ' || max(l_returnflag) ELSE '' END
    AS organization,
  CASE WHEN max(l_linestatus) = 'O' THEN 'Nationwide' END AS academic_level,
  CASE WHEN max(l_returnflag) = 'R' THEN 0.0 ELSE floor(min(l_extendedprice)) END AS min_award,
  floor(max(l_extendedprice)) AS max_award,
  CASE WHEN max(l_linenumber) > 1 THEN max(l_returnflag) = 'A' END AS renewable
  FROM lineitem GROUP BY l_orderkey)"""

PURPOSES = "(eligibility || ' R&D <fast> \"track\"')"
PROSE = "(eligibility || ' R&D <fast> track')"


def url_hash(c: str) -> str:
    units = f"list_transform(string_split({c}, ''), lambda ch: CAST(unicode(ch) AS BIGINT))"
    h = f"list_reduce(list_prepend(CAST(0 AS BIGINT), {units}), " \
        "lambda h, u: (h * 31 + u) % 4294967296)"
    return f"lower(to_hex(CASE WHEN {h} >= 2147483648 THEN 4294967296 - {h} ELSE {h} END))"


def defaults(profile: str, kinds: dict[str, str]) -> str:
    """Select list that fills the columns of ``kinds`` (column -> text/number/flag)."""
    out = []
    for name, default in DEFAULTS[profile].items():
        value = "NULL" if default is None else quoted(default) if isinstance(default, str) \
            else str(default).lower()
        kind = kinds.get(name)
        if kind == "text":
            value = f"coalesce(nullif({name}, ''), {value})"
        elif kind == "number":
            value = f"coalesce(nullif({name}, 0), {value})"
        elif kind == "flag":
            value = f"coalesce({name}, {value})"
        if name.endswith("_award"):
            value = f"CAST({value} AS DOUBLE)"
        out.append(f"{value} AS {name}")
    return ", ".join(out)
