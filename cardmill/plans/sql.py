"""SQL spellings shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from cardmill.functions import fixed

LINE_SPACE = (
    r"\t\x{0B}\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = r"\n" + LINE_SPACE
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
MANGLED = (
    rf"(?i)([A-Za-z0-9._%+\-]+)[{SPACE}]*(?:\(a\)|\[at\]|\{{at\}}|[{SPACE}]+at[{SPACE}]+|©|@)[{SPACE}]*"
    r"([A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
)
URL = rf"(?i)(?:https?://|www\.)[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}(?:/[^{SPACE}]*)?"
BARE = rf"\b[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?:/[^{SPACE}]*)?"
SUFFIX = r"\.(?:" + "|".join(s.replace(".", r"\.") for s in fixed.KNOWN_SUFFIXES) + ")$"
PHONE = rf"[+]?[0-9][0-9{LINE_SPACE}\-.()/]{{5,}}"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def terms(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def index_terms(x: str) -> str:
    return terms(f"strip_accents({x})")


def word_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def any_word(words) -> str:
    escaped = "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words)
    return f"(?:^|[^a-z0-9])(?:{escaped})(?:[^a-z0-9]|$)"


UNIT = (
    r"(?i)\b(?:" + "|".join(fixed.UNIT_WORDS) + rf")\b\.?[{SPACE}]*(?:no\b\.?)?[{SPACE}]*[:#.\-]?[{SPACE}]*[0-9]"
)
POSTCODE = rf"[A-Za-z][{SPACE}]*-[{SPACE}]*[0-9]{{4}}\b"


def looks_like_address(x: str) -> str:
    return (
        f"(regexp_matches(lower({x}), '{any_word(fixed.ADDRESS_WORDS)}') OR regexp_matches({x}, '{UNIT}') "
        f"OR regexp_matches({x}, '{POSTCODE}'))"
    )


def name_key(x: str, drop) -> str:
    return (
        f"nullif(array_to_string(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), "
        f"lambda w: w <> '' AND w NOT IN {word_list(drop)}), ' '), '')"
    )


def repaired(x: str) -> str:
    return f"translate({x}, '{fixed.CONFUSABLE_LETTERS}', '{fixed.CONFUSABLE_DIGITS}')"


def latin(x: str) -> str:
    return f"translate({x}, '{fixed.BENGALI_DIGITS}', '{fixed.LATIN_DIGITS}')"


def phone_reading(source: str, cleaned: str, keep: str) -> str:
    """SELECT of keep + e164, valid, kind, issue for the column ``cleaned`` of ``source``."""
    cc = fixed.COUNTRY_CODE
    operators = word_list(fixed.MOBILE_OPERATORS)
    return f"""
      SELECT {keep},
        CASE WHEN n NOT BETWEEN 6 AND 15 THEN NULL WHEN mobile OR landline THEN '+{cc}' || nat
             WHEN plus THEN '+' || digits END AS e164,
        CASE WHEN n NOT BETWEEN 6 AND 15 THEN FALSE WHEN mobile THEN ('0' || left(nat, 2)) IN {operators}
             WHEN landline THEN TRUE WHEN plus THEN n >= 8 ELSE FALSE END AS valid,
        CASE WHEN n NOT BETWEEN 6 AND 15 THEN 'unknown' WHEN mobile THEN 'mobile' WHEN landline THEN 'landline'
             WHEN plus THEN 'international' ELSE 'unknown' END AS kind,
        CASE WHEN n < 6 THEN 'tooShort' WHEN n > 15 THEN 'tooLong'
             WHEN mobile THEN CASE WHEN ('0' || left(nat, 2)) IN {operators} THEN NULL ELSE 'unknownOperator' END
             WHEN landline THEN NULL WHEN plus THEN CASE WHEN n >= 8 THEN NULL ELSE 'tooShort' END
             ELSE 'unrecognizedFormat' END AS issue
      FROM (SELECT *, left(nat, 1) = '1' AND len(nat) = 10 AS mobile,
                   left(nat, 1) <> '1' AND len(nat) BETWEEN 7 AND 10 AS landline
            FROM (SELECT *, len(digits) AS n, left(ltrim({cleaned}), 1) = '+' AS plus,
                    CASE WHEN digits LIKE '00{cc}%' THEN substr(digits, 6)
                         WHEN digits LIKE '{cc}%' AND len(digits) > 11 THEN substr(digits, 4)
                         WHEN digits LIKE '0%' THEN substr(digits, 2) ELSE digits END AS nat
                  FROM (SELECT *, regexp_replace({cleaned}, '[^0-9]', '', 'g') AS digits FROM {source}))
            WHERE digits <> '')"""


def phones(source: str, key: str = "id") -> str:
    """First occurrence of every number of ``source(key, text)``."""
    return f"""
    WITH found AS (SELECT {key}, regexp_extract_all({latin('text')}, '{PHONE}') AS c FROM {source}),
    cand AS (SELECT {key}, unnest(c) AS piece, generate_subscripts(c, 1) AS pos FROM found),
    part AS (SELECT {key}, pos, unnest(string_split(piece, '/')) AS piece,
                    generate_subscripts(string_split(piece, '/'), 1) AS sub FROM cand),
    raws AS (SELECT {key}, pos, sub, {trim('piece')} AS raw FROM part),
    parsed AS ({phone_reading('raws', 'raw', f'{key}, pos, sub, raw')})
    SELECT {key}, raw, e164, valid, kind, issue FROM parsed
    QUALIFY row_number() OVER (PARTITION BY {key}, CASE WHEN valid THEN e164 ELSE raw END ORDER BY pos, sub) = 1"""


def emails(source: str, key: str = "id") -> str:
    return f"""
    WITH clean AS (SELECT {key}, regexp_extract_all(text, '{EMAIL}') AS m FROM {source}),
    misread AS (SELECT {key}, list_filter(regexp_extract_all(text, '{MANGLED}'),
                  lambda x: NOT regexp_matches(x, '{EMAIL}')) AS m FROM {source}),
    every AS (
      SELECT {key}, 0 AS pass, generate_subscripts(m, 1) AS pos, unnest(m) AS raw, FALSE AS repaired FROM clean
      UNION ALL SELECT {key}, 1, generate_subscripts(m, 1), unnest(m), TRUE FROM misread),
    built AS (SELECT {key}, pass, pos, raw, repaired,
                lower(CASE WHEN repaired THEN regexp_extract(raw, '{MANGLED}', 1) || '@' || regexp_extract(raw, '{MANGLED}', 2)
                      ELSE raw END) AS normalized FROM every)
    SELECT {key}, raw, normalized, split_part(normalized, '@', 2) NOT LIKE '.%' AS valid, repaired,
           CASE WHEN split_part(normalized, '@', 2) LIKE '.%' THEN 'malformed_domain' END AS issue
    FROM built QUALIFY row_number() OVER (PARTITION BY {key}, normalized ORDER BY pass, pos) = 1"""


def websites(source: str, key: str = "id") -> str:
    return f"""
    WITH rest AS (SELECT {key}, regexp_replace(text, '{EMAIL}', ' ', 'g') AS t FROM {source}),
    links AS (SELECT {key}, regexp_extract_all(t, '{URL}') AS m FROM rest),
    bare AS (SELECT {key}, list_filter(regexp_extract_all(regexp_replace(t, '{URL}', ' ', 'g'), '{BARE}'),
               lambda x: regexp_matches(lower(split_part(x, '/', 1)), '{SUFFIX}')) AS m FROM rest),
    every AS (
      SELECT {key}, 0 AS pass, generate_subscripts(m, 1) AS pos, unnest(m) AS raw FROM links
      UNION ALL SELECT {key}, 1, generate_subscripts(m, 1), unnest(m) FROM bare),
    full_url AS (SELECT *, CASE WHEN regexp_matches(lower(raw), '^https?://') THEN lower(raw) ELSE 'https://' || lower(raw) END AS url FROM every),
    sites AS (SELECT *, regexp_replace(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^www\\.', '') AS domain FROM full_url)
    SELECT {key}, raw, url, domain FROM sites WHERE contains(domain, '.')
    QUALIFY row_number() OVER (PARTITION BY {key}, domain ORDER BY pass, pos) = 1"""


def category(x: str, cues=None) -> str:
    cues = fixed.CATEGORY_CUES if cues is None else cues
    options = []
    for i, (label, words) in enumerate(cues.items()):
        hits = " + ".join(f"contains({x}, '{w}')::INT" for w in words)
        options.append(f"{{'hits': {hits}, 'o': {-i}, 'label': '{label}'}}")
    best = f"list_max([{', '.join(options)}])"
    return f"(CASE WHEN ({best}).hits > 0 THEN ({best}).label END)"


def attribute(x: str, key: str) -> str:
    whens = []
    for value, words in fixed.ATTRIBUTE_CUES[key].items():
        hit = " OR ".join(f"contains({x}, '{w}')" for w in words)
        whens.append(f"WHEN {hit} THEN '{value}'")
    return "CASE " + " ".join(whens) + " END"
