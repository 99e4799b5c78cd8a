"""Registered queries over free text: contacts, validation, cues, names, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions import phones as P
from cardmill.functions import text as T
from cardmill.functions import vcard as V
from cardmill.functions import web as W
from cardmill.functions.scoring import cer, freshness
from cardmill.operators import contacts, cues
from cardmill.operators.resolve import duplicate_page, name_creations
from cardmill.plans import sql as S
from cardmill.sources.tables import read_input, spread

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# --- shared inputs -------------------------------------------------------------------------------


def all_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and conversation turns as one (id, text) table."""
    docs = read_input(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    turns = read_input(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), F.col("turn")).alias("id"), "text"
    )
    return docs.unionByName(turns)


ALL_TEXTS = """(SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations)"""


def web_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = read_input(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("url").alias("text"))
    return all_texts(spark, d).unionByName(pages)


WEB_TEXTS = f"(SELECT * FROM {ALL_TEXTS} UNION ALL SELECT 'p' || page_id, url FROM pages)"


# --- contacts ------------------------------------------------------------------------------------


@query("phone_extract", S.phones(ALL_TEXTS))
def phone_extract(spark, d):
    return contacts.extract_phones(all_texts(spark, d), "id", "text").select("id", "raw", "e164", "valid", "kind", "issue")


@query("email_extract", S.emails(ALL_TEXTS))
def email_extract(spark, d):
    return contacts.extract_emails(all_texts(spark, d), "id", "text").select(
        "id", "raw", "normalized", "valid", "repaired", "issue"
    )


@query("website_extract", S.websites(WEB_TEXTS))
def website_extract(spark, d):
    return contacts.extract_websites(web_texts(spark, d), "id", "text").select("id", "raw", "url", "domain")


@query(
    "page_contacts",
    f"""SELECT 'email' AS kind, id, normalized FROM ({S.emails("(SELECT page_id AS id, html AS text FROM pages)")})
    UNION ALL SELECT 'phone', id, e164 FROM ({S.phones("(SELECT page_id AS id, html AS text FROM pages)")}) WHERE valid""",
)
def page_contacts(spark, d):
    pages = read_input(spark, d, "pages")
    mail = contacts.extract_emails(pages, "page_id", "html").select(
        F.lit("email").alias("kind"), F.col("page_id").alias("id"), "normalized"
    )
    phone = contacts.extract_phones(pages, "page_id", "html").filter("valid").select(
        F.lit("phone").alias("kind"), F.col("page_id").alias("id"), F.col("e164").alias("normalized")
    )
    return mail.unionByName(phone)


_PHONE_SPELLINGS = [
    ("'017' || lpad(c_custkey::VARCHAR, 8, '0')", lambda k: F.concat(F.lit("017"), F.lpad(k, 8, "0"))),
    ("'Ol8' || lpad(c_custkey::VARCHAR, 8, '3')", lambda k: F.concat(F.lit("Ol8"), F.lpad(k, 8, "3"))),
    ("'+65 ' || lpad(c_custkey::VARCHAR, 9, '6')", lambda k: F.concat(F.lit("+65 "), F.lpad(k, 9, "6"))),
    ("'o12-' || c_custkey", lambda k: F.concat(F.lit("o12-"), k)),
    ("'০১৯' || lpad(c_custkey::VARCHAR, 8, '4')", lambda k: F.concat(F.lit("০১৯"), F.lpad(k, 8, "4"))),
]


def spelled_phones(spark: SparkSession, d: str) -> DataFrame:
    """Five spellings of a number per customer: clean, misread, foreign, too short, Bengali digits."""
    key = F.col("c_custkey").cast("string")
    return spread(read_input(spark, d, "customer")).select(
        "c_custkey", F.posexplode(F.array(*[f(key) for _, f in _PHONE_SPELLINGS])).alias("spelling", "value")
    )


SPELLED = " UNION ALL ".join(
    f"SELECT c_custkey, {i} AS spelling, {s} AS value FROM customer" for i, (s, _) in enumerate(_PHONE_SPELLINGS)
)


def phone_parse_sql(source: str, keys: str) -> str:
    """Both readings of every value; the better one, the plain one on a tie."""
    rank = "CASE WHEN NOT valid THEN 0 WHEN kind = 'mobile' THEN 3 WHEN kind = 'international' THEN 2 WHEN kind = 'landline' THEN 1 ELSE 0 END"
    return f"""
    SELECT * EXCLUDE (rk) FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {rank} DESC, repaired) AS rk FROM (
        SELECT *, FALSE AS repaired FROM ({S.phone_reading('shaped', 'plain', keys)})
        UNION ALL
        SELECT *, TRUE FROM ({S.phone_reading('(SELECT * FROM shaped WHERE letters <> plain)', 'letters', keys)})))
    WHERE rk = 1"""


def shaped_sql(source: str, keys: str) -> str:
    bare = f"regexp_replace(plain, '[{S.SPACE}\\-().+/]', '', 'g')"
    return f"""WITH src AS (SELECT * FROM ({source})),
    latin AS (SELECT *, {S.latin(S.trim('value'))} AS plain FROM src),
    shaped AS (SELECT {keys}, plain, {S.repaired('plain')} AS letters FROM latin
      WHERE len({bare}) > 0 AND len(regexp_replace({bare}, '[^0-9]', '', 'g')) / len({bare}) >= 0.6)"""


@query(
    "phone_parse",
    f"{shaped_sql(SPELLED, 'c_custkey, spelling')} {phone_parse_sql('shaped', 'c_custkey, spelling')}",
)
def phone_parse(spark, d):
    parsed = spelled_phones(spark, d).withColumn("p", P.phone_struct(F.col("value"))).filter(F.col("p").isNotNull())
    return parsed.select(
        "c_custkey", F.col("spelling").cast("long").alias("spelling"), "p.e164", "p.valid", "p.kind", "p.issue", "p.repaired"
    )


@query(
    "phone_display",
    f"""{shaped_sql(SPELLED, 'c_custkey, spelling')}, best AS ({phone_parse_sql('shaped', 'c_custkey, spelling')})
    SELECT c_custkey, spelling, regexp_replace(e164, '^\\+880(.+)$', '0\\1') AS shown,
      regexp_matches(e164, '^\\+8801[3-9][0-9]{{8}}$') AS mobile
    FROM best WHERE e164 IS NOT NULL""",
)
def phone_display(spark, d):
    parsed = spelled_phones(spark, d).withColumn("e164", P.phone_struct(F.col("value"))["e164"]).filter("e164 is not null")
    return parsed.select(
        "c_custkey",
        F.col("spelling").cast("long").alias("spelling"),
        P.national_format(F.col("e164")).alias("shown"),
        P.is_mobile(F.col("e164")).alias("mobile"),
    )


def typed_values(spark: SparkSession, d: str) -> DataFrame:
    """Values as a user might file them, right and wrong: (id, field_key, value)."""
    pages, bench, cust = (read_input(spark, d, n) for n in ("pages", "benchmark", "customer"))
    part = lambda df, key, idc, col: df.select(
        F.concat(F.lit(key + ":"), idc).alias("id"), F.lit(key).alias("field_key"), col.alias("value")
    )
    url, mail = F.col("url"), F.concat(F.lit("info(a)"), F.regexp_extract("url", "^https?://([^/]+)", 1))
    return (
        part(pages, "website", F.col("page_id"), url)
        .unionByName(part(pages, "email", F.col("page_id"), mail))
        .unionByName(part(bench, "person_name", F.col("item_id"), F.col("text")))
        .unionByName(part(bench, "company", F.col("item_id"), F.col("text")))
        .unionByName(part(cust, "address", F.col("c_custkey"), F.lit(" ")))
        .unionByName(
            spelled_phones(spark, d).select(
                F.concat(F.lit("phone:"), F.col("c_custkey"), F.lit("."), F.col("spelling")).alias("id"),
                F.lit("phone").alias("field_key"), "value",
            )
        )
    )


_EMAILS_OF = "(SELECT page_id AS id, 'info(a)' || regexp_extract(url, '^https?://([^/]+)', 1) AS text FROM pages)"


@query(
    "contact_validate",
    f"""WITH site AS (SELECT id, arg_min(domain, len(raw)) AS domain FROM ({S.websites("(SELECT page_id AS id, url AS text FROM pages)")}) GROUP BY id),
    mail AS ({S.emails(_EMAILS_OF)}),
    ph AS ({shaped_sql(SPELLED, 'c_custkey, spelling')} {phone_parse_sql('shaped', 'c_custkey, spelling')})
    SELECT 'website:' || page_id AS id, 'website' AS field_key, domain AS normalized,
           CASE WHEN domain IS NULL THEN 'not_a_website' END AS issue FROM pages LEFT JOIN site ON id = page_id
    UNION ALL SELECT 'email:' || page_id, 'email', CASE WHEN m.valid THEN m.normalized END,
      CASE WHEN m.id IS NULL THEN 'not_an_email' ELSE coalesce(m.issue, CASE WHEN repaired THEN 'ocr_repaired' END) END
      FROM pages LEFT JOIN mail m ON m.id = page_id
    UNION ALL SELECT 'person_name:' || item_id, 'person_name', NULL,
      CASE WHEN {S.looks_like_address('text')} THEN 'looks_like_address' END FROM benchmark
    UNION ALL SELECT 'company:' || item_id, 'company', NULL, NULL FROM benchmark
    UNION ALL SELECT 'address:' || c_custkey, 'address', NULL, 'empty' FROM customer
    UNION ALL SELECT 'phone:' || s.c_custkey || '.' || s.spelling, 'phone', CASE WHEN valid THEN e164 END,
      CASE WHEN ph.c_custkey IS NULL THEN 'unrecognizedFormat' WHEN NOT valid THEN coalesce(issue, 'unrecognizedFormat')
           WHEN repaired THEN 'ocr_repaired' END
      FROM ({SPELLED}) s LEFT JOIN ph ON ph.c_custkey = s.c_custkey AND ph.spelling = s.spelling""",
)
def contact_validate(spark, d):
    return contacts.validate_fields(typed_values(spark, d)).select("id", "field_key", "normalized", "issue")


@query(
    "digit_functions",
    f"""SELECT doc_id, len(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
      regexp_matches(text, '[{fixed.BENGALI_DIGITS}]') AS has_bengali,
      md5({S.repaired('text')}) AS repaired_md5, md5({S.latin('text')}) AS latin_md5,
      round(CASE WHEN len(b) = 0 THEN 0 ELSE len(regexp_replace(b, '[^0-9]', '', 'g')) / len(b) END, 6) AS digit_ratio
    FROM (SELECT *, regexp_replace(text, '[{S.SPACE}\\-().+/]', '', 'g') AS b FROM documents)""",
)
def digit_functions(spark, d):
    text = F.col("text")
    return read_input(spark, d, "documents").select(
        "doc_id",
        F.length(T.digits_only(text)).cast("long").alias("n_digits"),
        T.has_bengali_digits(text).alias("has_bengali"),
        F.md5(T.repair_confusables(text)).alias("repaired_md5"),
        F.md5(T.to_latin(text)).alias("latin_md5"),
        F.round(T.digit_ratio(text), 6).alias("digit_ratio"),
    )


@query(
    "address_words",
    f"""SELECT doc_id, {S.looks_like_address('text')} AS looks_like_address,
      regexp_matches(lower(text), '{S.any_word(fixed.DESIGNATION_WORDS)}') AS has_title,
      regexp_matches(lower(text), '{S.any_word(fixed.COMPANY_WORDS)}') AS has_company FROM documents""",
)
def address_words(spark, d):
    text = F.col("text")
    return read_input(spark, d, "documents").select(
        "doc_id",
        T.looks_like_address(text).alias("looks_like_address"),
        T.contains_word(text, fixed.DESIGNATION_WORDS).alias("has_title"),
        T.contains_word(text, fixed.COMPANY_WORDS).alias("has_company"),
    )


@query(
    "domain_match",
    """SELECT page_id, host, len(squashed) > 0 AND len(label) >= 4 AND (contains(squashed, label) OR contains(label, squashed)) AS matches,
         CASE WHEN contains(host, '.') THEN host END AS mail_domain
       FROM (SELECT page_id, host, split_part(host, '.', 1) AS label, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS squashed
         FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host,
                      split_part(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.', 2) || '-Shop' AS word FROM pages))""",
)
def domain_match(spark, d):
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return (
        read_input(spark, d, "pages")
        .select("page_id", host.alias("full_host"))
        .withColumn("host", F.regexp_replace(F.lower("full_host"), r"^www\.", ""))
        .withColumn("word", F.concat(F.split("full_host", r"\.").getItem(1), F.lit("-Shop")))
        .select(
            "page_id",
            "host",
            T.matches_domain(F.col("word"), F.col("host")).alias("matches"),
            W.email_domain(F.concat(F.lit("info@"), F.col("full_host"))).alias("mail_domain"),
        )
    )


# --- cues ----------------------------------------------------------------------------------------


@query("classify_cues", f"SELECT id, {S.category('lower(text)')} AS category FROM {ALL_TEXTS}")
def classify_cues(spark, d):
    return cues.classify_cues(all_texts(spark, d), "id", "text")


@query(
    "attribute_cues",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT id, '{k}' AS key, {S.attribute('lower(text)', k)} AS value, 0.6::DOUBLE AS confidence FROM {ALL_TEXTS}"
        for k in fixed.ATTRIBUTE_CUES
    )
    + ") WHERE value IS NOT NULL",
)
def attribute_cues(spark, d):
    return cues.attribute_cues(all_texts(spark, d), "id", "text")


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """Searchable subjects: a document's text, and as its notes the user turns of the conversation of that number."""
    notes = (
        read_input(spark, d, "conversations")
        .filter(F.col("role") == "user")
        .groupBy(F.col("conv_id").alias("doc_id"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("n"))
        .select("doc_id", F.array_join(F.col("n.text"), "\n").alias("note_text"))
    )
    return (
        read_input(spark, d, "documents")
        .join(notes, "doc_id", "left")
        .select(
            F.col("doc_id").alias("subject_id"),
            F.col("text").alias("card_text"),
            F.coalesce("note_text", F.lit("")).alias("note_text"),
            F.lit("").alias("canonical_en"),
            F.lit("").alias("tags"),
        )
    )


SUBJECTS = """(SELECT doc_id AS subject_id, documents.text AS card_text, coalesce(note, '') AS note_text FROM documents LEFT JOIN
  (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS note FROM conversations WHERE role = 'user' GROUP BY conv_id)
  ON conv_id = doc_id)"""


@query(
    "profile_build",
    f"""SELECT subject_id, md5(canonical) AS canonical_md5, {S.category('lower(canonical)')} AS category, 'deterministic' AS model
    FROM (SELECT subject_id, {S.trim("concat_ws(chr(10), card_text, note_text)")} AS canonical FROM {SUBJECTS}) WHERE canonical <> ''""",
)
def profile_build(spark, d):
    return cues.build_profiles(subjects(spark, d)).select(
        "subject_id",
        F.md5("canonical_en").alias("canonical_md5"),
        F.get("categories", F.lit(0)).alias("category"),
        "model",
    )


_ANSWER = "coalesce(source, '') || ', ' || coalesce(lang, '') || ',x,' || chr(10) || repeat('y', 45)"


@query(
    "query_expansion",
    f"""SELECT item_id AS query_id, text AS raw, array_to_string([text] || coalesce(kw, []), ' ') AS gloss
    FROM benchmark LEFT JOIN (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_ANSWER}, '[,\\n]'), lambda k: trim(k)),
      lambda k: k <> '' AND len(k) < 40) AS kw FROM documents) ON doc_id = item_id""",
)
def query_expansion(spark, d):
    answers = read_input(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.concat(
            F.coalesce("source", F.lit("")), F.lit(", "), F.coalesce("lang", F.lit("")), F.lit(",x,\n"), F.repeat(F.lit("y"), 45)
        ).alias("answer"),
    )
    queries = read_input(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return cues.query_intents(queries, answers)


def answered_turns(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with a made-up answer in the asked-for format, built from the row itself."""
    return read_input(spark, d, "conversations").select(
        F.concat_ws(".", "conv_id", "turn").alias("id"),
        "text",
        F.when(
            F.col("role") == "user",
            F.concat(F.lit("Quality: "), F.col("role"), F.lit("\nmood: fine\nkeywords: A b, ,"), F.col("turn"), F.lit("\nservice:\nlocation: x:"), F.col("conv_id")),
        ).otherwise(F.concat(F.lit("no format "), F.col("turn"))).alias("answer"),
        F.when(F.col("turn") == 0, F.lit("Books, of course")).otherwise(F.lit("something else")).alias("label_answer"),
    )


ANSWERED = """(SELECT conv_id || '.' || turn AS id, role, turn, conv_id, text, CASE WHEN role = 'user' THEN 'Quality: ' || role || chr(10) || 'mood: fine' || chr(10) ||
  'keywords: A b, ,' || turn || chr(10) || 'service:' || chr(10) || 'location: x:' || conv_id ELSE 'no format ' || turn END AS answer FROM conversations)"""


@query(
    "answer_key_values",
    f"""SELECT id, 'quality' AS key, role AS value, 0.8::DOUBLE AS confidence FROM {ANSWERED} WHERE role = 'user'
    UNION ALL SELECT id, 'location', 'x:' || conv_id, 0.8 FROM {ANSWERED} WHERE role = 'user' """
    + "".join(
        f" UNION ALL SELECT * FROM (SELECT id, '{k}', {S.attribute('lower(text)', k)} AS v, 0.6 FROM {ANSWERED} WHERE role <> 'user') WHERE v IS NOT NULL"
        for k in fixed.ATTRIBUTE_CUES
    ),
)
def answer_key_values(spark, d):
    return cues.parse_key_values(answered_turns(spark, d), "id", "answer", "text")


@query(
    "answer_keywords",
    f"""SELECT id, CASE WHEN role = 'user' THEN 'a b|' || turn ELSE '' END AS services,
      md5({S.trim("concat_ws(chr(10), CASE WHEN role = 'user' THEN 'Quality: user' || chr(10) || 'mood: fine' || chr(10) || 'service:' || chr(10) || 'location: x:' || conv_id ELSE answer END, text)")}) AS canonical_md5,
      {S.category('lower(text)')} AS category FROM {ANSWERED}""",
)
def answer_keywords(spark, d):
    return cues.parse_keywords(answered_turns(spark, d), "id", "answer", "text").select(
        "id",
        F.array_join("services", "|").alias("services"),
        F.md5("canonical_en").alias("canonical_md5"),
        F.get("categories", F.lit(0)).alias("category"),
    )


@query(
    "answer_label",
    f"SELECT id, CASE WHEN turn = 0 THEN 'books' ELSE {S.category('lower(text)')} END AS category, turn = 0 AS accepted FROM {ANSWERED}",
)
def answer_label(spark, d):
    return cues.accept_label(answered_turns(spark, d), "id", "label_answer", "text")


# --- names ---------------------------------------------------------------------------------------


def named_people(spark: SparkSession, d: str) -> DataFrame:
    """Customers under a name of honorific, segment and nation: very few distinct names, so hot ones."""
    cust, nation = read_input(spark, d, "customer"), read_input(spark, d, "nation")
    return cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("person_id"),
        F.concat(
            F.when(F.col("c_acctbal") < 0, "Md. ").otherwise(""), F.initcap("c_mktsegment"), F.lit("  "), F.col("n_name"),
        ).alias("display_name"),
    )


NAMED = """(SELECT c_custkey AS person_id, CASE WHEN c_acctbal < 0 THEN 'Md. ' ELSE '' END || upper(left(c_mktsegment, 1)) ||
  lower(substr(c_mktsegment, 2)) || '  ' || n_name AS display_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_CREATED = f"""(SELECT person_id, {S.name_key('display_name', fixed.HONORIFICS)} AS name_key,
  row_number() OVER (PARTITION BY {S.name_key('display_name', fixed.HONORIFICS)} ORDER BY person_id) AS position FROM {NAMED})"""


@query("same_name_people", f"SELECT * FROM {_CREATED}")
def same_name_people(spark, d):
    return name_creations(named_people(spark, d)).select("person_id", "name_key", F.col("position").cast("long").alias("position"))


@query(
    "duplicate_page",
    f"""SELECT row_number() OVER (ORDER BY b.person_id, a.person_id) AS pair_no, a.person_id AS a_id, b.person_id AS b_id, 0.6::DOUBLE AS score
    FROM {_CREATED} a JOIN {_CREATED} b ON a.name_key = b.name_key AND a.person_id < b.person_id
    QUALIFY pair_no BETWEEN 201 AND 300""",
)
def same_name_page(spark, d):
    """The third page of a hundred pairs a reviewer would see."""
    return duplicate_page(name_creations(named_people(spark, d)), 200, 100).select("pair_no", "a_id", "b_id", "score")


@query(
    "name_normalize",
    f"""SELECT 'person' AS kind, person_id AS id, {S.name_key('display_name', fixed.HONORIFICS)} AS name_key FROM {NAMED}
    UNION ALL SELECT 'org', s_suppkey, {S.name_key("s_name || ' Pvt. Ltd.'", fixed.LEGAL_SUFFIXES)} FROM supplier""",
)
def name_normalize(spark, d):
    people = named_people(spark, d).select(
        F.lit("person").alias("kind"), F.col("person_id").alias("id"), T.person_key(F.col("display_name")).alias("name_key")
    )
    orgs = read_input(spark, d, "supplier").select(
        F.lit("org").alias("kind"), F.col("s_suppkey").alias("id"), T.org_key(F.concat("s_name", F.lit(" Pvt. Ltd."))).alias("name_key")
    )
    return people.unionByName(orgs)


@query(
    "initials_and_files",
    f"""SELECT person_id, upper(left(parts[1], 1) || left(parts[-1], 1)) AS initials,
      regexp_replace(regexp_replace(trim(display_name), '[^A-Za-z0-9 _-]', '', 'g'), ' +', '_', 'g') AS file_name,
      parts_all[-1] || ';' || array_to_string(parts_all[:-2], ' ') || ';;;' AS structured
    FROM (SELECT *, list_filter(string_split(display_name, ' '), lambda p: p <> '') AS parts_all,
      list_filter(string_split(display_name, ' '), lambda p: p <> '' AND lower(p) NOT IN {S.word_list(fixed.INITIALS_SKIP)}) AS parts FROM {NAMED})""",
)
def initials_and_files(spark, d):
    name = F.col("display_name")
    return named_people(spark, d).select(
        "person_id",
        T.initials(name).alias("initials"),
        V.safe_file_name(name).alias("file_name"),
        V.structured_name(name).alias("structured"),
    )


# --- words and error rates -----------------------------------------------------------------------


@query(
    "matched_terms",
    f"""SELECT conv_id, turn, array_to_string(list_filter(list_distinct_ordered, lambda t: len(list_filter(ws, lambda w: starts_with(w, t))) > 0), ' ') AS matched
    FROM (SELECT conv_id, turn, list_distinct({S.terms('d.text')}) AS ws,
      list_transform(list_sort(list_transform(list_distinct({S.terms('c.text')}), lambda t: {{'p': list_position({S.terms('c.text')}, t), 't': t}})), lambda s: s.t) AS list_distinct_ordered
      FROM conversations c JOIN documents d ON d.doc_id = c.conv_id)""",
)
def matched_terms(spark, d):
    docs = read_input(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("doc_text"))
    return read_input(spark, d, "conversations").join(docs, "conv_id").select(
        "conv_id", "turn", F.array_join(T.matched_terms(F.col("text"), F.col("doc_text")), " ").alias("matched")
    )


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the next one of its conversation."""
    turns = read_input(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("said"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("said").alias("answer"))
    return turns.join(following, ["conv_id", "turn"])


# DuckDB counts the edits of bytes: every letter beyond ASCII becomes a control character that stands for it alone.
_ONE_BYTE = rf"""far AS (SELECT string_agg(c, '' ORDER BY c) AS letters FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM conversations) WHERE unicode(c) > 126),
said AS (SELECT conv_id, turn, role, {S.trim(f"regexp_replace(translate(text, letters, array_to_string(list_transform(range(1, len(letters) + 1), lambda i: chr(((ARRAY[1,2,3,4,5,6,7,8,14,15,16,17,18,19,20,21,22,23,24,25,26,27,28,29,30,31,127])[i])::INTEGER)), '')), '[{S.SPACE}]+', ' ', 'g')")} AS said
  FROM conversations, far)"""


@query(
    "cer_by_group",
    f"""WITH {_ONE_BYTE} SELECT role, count(*) AS n, round(avg(cer), 6) AS mean_cer FROM (
      SELECT role, CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0 ELSE 1 END ELSE levenshtein(r, h) / len(r) END AS cer FROM (
        SELECT a.role, a.said AS r, b.said AS h FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)) GROUP BY role""",
)
def cer_by_group(spark, d):
    return (
        turn_pairs(spark, d)
        .withColumn("cer", cer(F.col("said"), F.col("answer")))
        .groupBy("role")
        .agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("mean_cer"))
    )


@query(
    "freshness_decay",
    """SELECT o_orderkey, round(CASE WHEN age < 0 THEN 1 ELSE pow(0.5, age / (730 * 86400.0)) END, 6) AS freshness
    FROM (SELECT o_orderkey, epoch(TIMESTAMP '2001-06-30') - epoch(o_orderdate) AS age FROM orders)""",
)
def freshness_decay(spark, d):
    as_of = F.lit("2001-06-30").cast("timestamp")
    return read_input(spark, d, "orders").select(
        "o_orderkey", F.round(freshness(F.col("o_orderdate"), as_of), 6).alias("freshness")
    )


@query(
    "region_rects",
    """SELECT l_orderkey, l_linenumber, l_discount * 100 AS "left", l_tax * 100 AS top, l_quantity AS "right", l_linenumber::DOUBLE AS bottom
    FROM lineitem WHERE l_returnflag <> 'R'""",
)
def region_rects(spark, d):
    text = F.concat_ws(
        ", ", F.col("l_discount") * 100, F.col("l_tax") * 100, F.when(F.col("l_returnflag") == "R", "x").otherwise(F.col("l_quantity").cast("string")), "l_linenumber"
    )
    return (
        read_input(spark, d, "lineitem")
        .select("l_orderkey", "l_linenumber", T.parse_rect(text).alias("r"))
        .filter("r is not null")
        .select("l_orderkey", "l_linenumber", "r.left", "r.top", "r.right", "r.bottom")
    )
