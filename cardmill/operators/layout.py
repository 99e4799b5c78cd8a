"""Field extraction from layout blocks: relational passes over the whole blocks table.

Every pass works on (card_id, order_index) rows; what a card as a whole decides is a small aggregate
joined back, so no card is ever collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.phones import phone_key, phones, shown_phone
from cardmill.functions.text import (
    contains_word,
    let,
    looks_like_address,
    matches_domain,
    rect_text,
    trim,
)
from cardmill.functions.web import emails, websites
from cardmill.operators.fields import keep_first, unassigned_blocks
from cardmill.operators.ordering import global_position
from cardmill.session import written

# Lengths of names and titles; type sizes against the largest and against the line above; the gap below a line
# in sizes of the lower one, and the share of the narrower line that both must cover.
NAME_LENGTH = 80
TITLE_LENGTH = 60
PROMINENT = 0.75
SUBTITLE_RATIO = 0.75
MOST_GAP = 0.8
COVERED = 0.5

# A merge adds a space and at least one letter, so no name of 80 letters has more followers than this.
LONGEST_STACK = NAME_LENGTH // 2
# Cards with more free lines than this are ordered across tasks instead of within one.
ORDERED_LINES = 4096

FIELD_COLUMNS = [
    "card_id", "field_key", "value", "normalized_value", "raw_text", "confidence", "region_rect", "issue",
    "needs_review", "block_indices", "stage", "pos",
]


def measured(blocks: DataFrame) -> DataFrame:
    """Adds trimmed text, type size (short side of the box) and usable confidence."""
    return (
        blocks.withColumn("txt", trim(F.col("text")))
        .withColumn("size", F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")))
        .withColumn(
            "conf", F.when(F.col("confidence") >= 0, F.col("confidence")).otherwise(fixed.UNKNOWN_CONFIDENCE_SCORE)
        )
    )


def _field(df: DataFrame, stage: int, key: str, value: Column, confidence: Column, blocks: Column, **extra) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "card_id",
        F.lit(key).alias("field_key"),
        value.alias("value"),
        none.alias("normalized_value"),
        none.alias("raw_text"),
        confidence.alias("confidence"),
        extra.get("rect", none).alias("region_rect"),
        extra.get("issue", none).alias("issue"),
        F.lit(extra.get("review", False)).alias("needs_review"),
        blocks.cast("array<int>").alias("block_indices"),
        F.lit(stage).alias("stage"),
        F.lit(0).alias("pos"),
    )


# --- patterns ------------------------------------------------------------------------------------


def extract_patterns(blocks: DataFrame) -> DataFrame:
    """Phones, e-mails and sites of every block; each value once per card, at its first block."""
    conf = F.col("conf")

    def phone(p: Column) -> Column:
        shown = shown_phone(p)
        restored = F.when(shown != p["raw"], F.lit("digit_restored"))
        return _hit(
            "phone", phone_key(p), shown, p["e164"], F.when(shown != p["raw"], p["raw"]),
            F.when(p["valid"], conf).otherwise(conf * 0.5),
            F.coalesce(p["issue"], F.when(p["repaired"], F.lit("ocr_repaired")), restored),
            ~p["valid"] | p["repaired"] | (shown != p["raw"]),
        )

    def email(e: Column) -> Column:
        return _hit(
            "email", e["normalized"], trim(e["raw"]), e["normalized"], F.lit(None),
            F.when(e["valid"], conf).otherwise(conf * 0.5),
            F.coalesce(e["issue"], F.when(e["repaired"], F.lit("ocr_repaired"))),
            ~e["valid"] | e["repaired"],
        )

    def site(s: Column) -> Column:
        return _hit(
            "website", s["domain"], trim(s["raw"]), s["domain"], F.lit(None), conf, F.lit(None), F.lit(False)
        )

    def _hit(key, identity, value, normalized, raw, confidence, issue, review) -> Column:
        return F.struct(
            F.lit(key).alias("field_key"),
            identity.alias("identity"),
            value.alias("value"),
            normalized.cast("string").alias("normalized_value"),
            raw.cast("string").alias("raw_text"),
            confidence.cast("double").alias("confidence"),
            issue.cast("string").alias("issue"),
            review.alias("needs_review"),
        )

    hits = F.concat(
        F.transform(phones(F.col("text")), phone),
        F.transform(emails(F.col("text")), email),
        F.transform(websites(F.col("text")), site),
    )
    found = (
        blocks.select(
            "card_id",
            "order_index",
            rect_text(*[F.col(c) for c in ("left", "top", "right", "bottom")]).alias("region_rect"),
            F.posexplode(hits).alias("pos", "h"),
        )
        .select("card_id", "order_index", "region_rect", "pos", "h.*")
    )
    first = keep_first(found, ["card_id", "field_key", "identity"], ["order_index", "pos"])
    return first.withColumn("block_indices", F.array(F.col("order_index").cast("int"))).withColumn(
        "stage", F.lit(0)
    )


# --- address and designation ---------------------------------------------------------------------


def extract_address(free: DataFrame) -> DataFrame:
    """Every free line that reads as an address, joined in block order."""
    lines = free.filter("is_address").groupBy("card_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "order_index", "txt", "conf",
                    rect_text(*[F.col(c) for c in ("left", "top", "right", "bottom")]).alias("rect"),
                )
            )
        ).alias("lines")
    )
    head = F.col("lines").getItem(0)
    return _field(
        lines, 1, "address", F.array_join(F.col("lines.txt"), ", "), head["conf"] * 0.8,
        F.col("lines.order_index"), rect=head["rect"],
    )


def extract_designation(free: DataFrame, sizes: DataFrame) -> DataFrame:
    """The first free line holding a job title that is not among the largest type on the card."""
    titles = free.filter(
        ~F.col("is_address")
        & F.length("txt").between(1, TITLE_LENGTH)
        & contains_word(F.col("txt"), fixed.DESIGNATION_WORDS)
    )
    prominent = (F.col("max_size") > 0) & (F.col("size") >= F.col("max_size") * PROMINENT)
    first = (
        titles.join(sizes, "card_id")
        .filter(~prominent)
        .groupBy("card_id")
        .agg(F.min_by(F.struct("order_index", "txt", "conf", "left", "top", "right", "bottom"), "order_index").alias("b"))
    )
    return _field(
        first, 2, "designation", F.col("b.txt"), F.col("b.conf") * 0.85, F.array("b.order_index"),
        rect=rect_text(*[F.col(f"b.{c}") for c in ("left", "top", "right", "bottom")]),
    )


# --- names ---------------------------------------------------------------------------------------


def evidence(patterns: DataFrame, designation: DataFrame) -> DataFrame:
    """Per card: the known domain, and whether a person shows (job title or personal mailbox)."""
    local = F.substring_index("normalized_value", "@", 1)
    personal = (F.col("field_key") == "email") & (local != "") & ~local.isin(fixed.GENERIC_MAILBOXES) & ~local.rlike("^[0-9]+$")
    host = F.when(F.col("field_key").isin("website", "email"), F.substring_index("normalized_value", "@", -1))
    found = patterns.groupBy("card_id").agg(
        F.min_by(host, F.when(host.isNotNull(), F.struct("order_index", "pos"))).alias("domain"),
        F.max(F.coalesce(personal, F.lit(False))).alias("personal_email"),
    )
    titled = designation.select("card_id", F.col("block_indices").getItem(0).alias("title_index"))
    return found.join(titled, "card_id", "full").select(
        "card_id",
        "domain",
        "title_index",
        (F.col("title_index").isNotNull() | F.coalesce("personal_email", F.lit(False))).alias("has_person"),
    )


def looks_like_company(text: Column, domain: Column) -> Column:
    return contains_word(text, fixed.COMPANY_WORDS) | F.coalesce(matches_domain(text, domain), F.lit(False))


def _stacks_under(above: Column, below: Column) -> Column:
    """A line in clearly smaller type close under another one, most of the narrower of them in the same columns."""
    type_size = below["size"]
    smaller = (type_size > 0) & (type_size <= SUBTITLE_RATIO * above["size"])
    close = (below["top"] - above["bottom"]).between(-type_size, MOST_GAP * type_size)
    columns = [line["right"] - line["left"] for line in (above, below)]
    common = F.least(above["right"], below["right"]) - F.greatest(above["left"], below["left"])
    return smaller & close & (F.least(*columns) > 0) & (common > COVERED * F.least(*columns))


_LINE = "struct<txt:string,left:double,top:double,right:double,bottom:double,conf:double,size:double,open:boolean,indices:array<int>>"


def _line(txt, left, top, right, bottom, conf, size, is_open, indices) -> Column:
    names = ["txt", "left", "top", "right", "bottom", "conf", "size", "open", "indices"]
    return F.struct(
        *[v.alias(n) for v, n in zip([txt, left, top, right, bottom, conf, size, is_open, indices], names)]
    ).cast(_LINE)


def _merge_windows(lines: DataFrame, partition: list[str]) -> DataFrame:
    order = Window.partitionBy(*partition).orderBy("top", "order_index")
    ahead = order.rowsBetween(1, LONGEST_STACK)
    behind = order.rowsBetween(-LONGEST_STACK, -1)
    item = F.struct(
        "txt", "left", "top", "right", "bottom", "conf", "size", F.col("looks").alias("open"),
        F.array(F.col("order_index").cast("int")).alias("indices"),
    ).cast(_LINE)

    def add(above: Column, below: Column) -> Column:
        text = F.concat_ws(" ", above["txt"], below["txt"])
        fits = (
            above["open"]
            & below["open"]
            & ~looks_like_company(above["txt"], F.col("domain"))
            & _stacks_under(above, below)
            & (F.length(text) <= NAME_LENGTH)
        )
        merged = _line(
            text,
            F.least(above["left"], below["left"]),
            F.least(above["top"], below["top"]),
            F.greatest(above["right"], below["right"]),
            F.greatest(above["bottom"], below["bottom"]),
            F.least(above["conf"], below["conf"]),
            F.greatest(above["size"], below["size"]),
            F.lit(True),
            F.concat(above["indices"], below["indices"]),
        )
        closed = _line(*[above[n] for n in ("txt", "left", "top", "right", "bottom", "conf", "size")], F.lit(False), above["indices"])
        return F.when(fits, merged).otherwise(closed)

    head = F.struct(
        "txt", "left", "top", "right", "bottom", "conf", "size", (~F.col("looks")).alias("open"),
        F.array(F.col("order_index").cast("int")).alias("indices"),
    ).cast(_LINE)
    stacked = (
        lines.withColumn("followers", F.collect_list(item).over(ahead))
        .withColumn("next_looks", F.lead("looks").over(order))
        .withColumn("stack", F.when(~F.col("looks") & F.col("next_looks"), F.aggregate("followers", head, add)).otherwise(head))
        .drop("followers", "next_looks")
    )
    taken = F.flatten(F.collect_list(F.when(F.size("stack.indices") > 1, F.col("stack.indices"))).over(behind))
    return stacked.withColumn("absorbed", F.array_contains(taken, F.col("order_index").cast("int"))).filter(
        ~F.coalesce(F.col("absorbed"), F.lit(False))
    )


def merge_stacked(lines: DataFrame) -> DataFrame:
    """A brand line and the smaller company line set right under it become one candidate.

    The fold over a card's lines from top to bottom only ever looks at the lines right after a line
    without company signal, and at most ``LONGEST_STACK`` of them. Cards with very many lines get their
    order from a range-partitioned position and are folded in slices that overlap by that much.
    """
    counted = lines.groupBy("card_id").agg(F.count("*").alias("n_lines"))
    huge = counted.filter(F.col("n_lines") > ORDERED_LINES).select("card_id")
    usual = _merge_windows(lines.join(huge, "card_id", "left_anti"), ["card_id"])
    if huge.isEmpty():
        return usual
    placed = global_position(
        lines.join(huge, "card_id", "left_semi"), [F.col("card_id"), F.col("top"), F.col("order_index")], "place"
    )
    own = F.floor(F.col("place") / ORDERED_LINES)
    into = F.pmod(F.col("place"), F.lit(ORDERED_LINES))
    slices = F.filter(
        F.array(
            F.when(into < LONGEST_STACK, own - 1),
            own,
            F.when(into >= ORDERED_LINES - LONGEST_STACK, own + 1),
        ),
        lambda s: s.isNotNull(),
    )
    sliced = placed.withColumn("own", own).withColumn("slice", F.explode(slices)).drop("place")
    folded = _merge_windows(sliced, ["card_id", "slice"]).filter(F.col("slice") == F.col("own"))
    return usual.unionByName(folded.drop("slice", "own"))


def extract_names(usable: DataFrame) -> DataFrame:
    """Company and, when something shows a person, the person; ``usable`` carries domain and has_person."""
    lines = written(usable.withColumn("looks", looks_like_company(F.col("txt"), F.col("domain"))))
    single = F.struct(
        "txt", "left", "top", "right", "bottom", "conf", "size", F.lit(False).alias("open"),
        F.array(F.col("order_index").cast("int")).alias("indices"),
    ).cast(_LINE)
    singles = lines.filter("has_person").withColumn("stack", single)
    merged = merge_stacked(lines.filter(~F.col("has_person")))
    keep = ["card_id", "order_index", "domain", "has_person", "stack"]
    candidates = singles.select(*keep).unionByName(merged.select(*keep))
    text = F.col("stack.txt")
    kind = (
        F.when(looks_like_company(text, F.col("domain")), 0).when(looks_like_address(text), 2).otherwise(1)
    )
    # The best two of each kind decide; the limit applies before the shuffle.
    order = Window.partitionBy("card_id", "kind").orderBy(F.desc("stack.size"), "stack.top", "order_index")
    best = (
        candidates.withColumn("kind", kind)
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= 2)
        .groupBy("card_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.col("stack.size")).alias("neg_size"), F.col("stack.top").alias("top"), "order_index",
                        "kind", "stack",
                    )
                )
            ).alias("ranked"),
            F.max("has_person").alias("has_person"),
        )
    )
    company = F.coalesce(
        F.get(F.filter("ranked", lambda c: c["kind"] == 0), F.lit(0)), F.col("ranked").getItem(0)
    )
    person = F.get(
        F.filter("ranked", lambda c: (c["kind"] == 1) & (c["order_index"] != F.col("company.order_index"))), F.lit(0)
    )
    picked = (
        best.withColumn("company", company)
        .withColumn("confident", F.col("company.kind") == 0)
        .withColumn("person", F.when(F.col("has_person") | F.col("confident"), person))
    )

    def box(name: str) -> Column:
        return rect_text(*[F.col(f"{name}.stack.{c}") for c in ("left", "top", "right", "bottom")])

    companies = _field(
        picked, 3, "company", F.col("company.stack.txt"),
        F.col("company.stack.conf") * F.when(F.col("confident"), 0.85).otherwise(0.7),
        F.col("company.stack.indices"), rect=box("company"), review=True,
    )
    named = picked.filter(F.col("person").isNotNull())
    issue = cross_issue(F.col("person.stack.txt"), F.col("company.stack.txt"))
    people = _field(
        named, 4, "person_name", F.col("person.stack.txt"),
        F.col("person.stack.conf") * 0.7 * F.when(issue.isNotNull(), 0.5).otherwise(1.0),
        F.col("person.stack.indices"), rect=box("person"), issue=issue, review=True,
    )
    return companies.unionByName(people)


def cross_issue(person: Column, company: Column) -> Column:
    """A person named like the company, or like an address, was misread."""
    return F.when(F.lower(person) == F.lower(company), F.lit("same_as_company")).when(
        contains_word(person, fixed.ADDRESS_WORDS), F.lit("looks_like_address")
    )


def cross_checks(fields: DataFrame) -> DataFrame:
    """The same check on a finished field table: flags the name and halves its confidence."""
    company = fields.filter(F.col("field_key") == "company").groupBy("card_id").agg(
        F.min_by("value", F.struct("stage", "pos")).alias("company")
    )
    joined = fields.join(company, "card_id", "left").withColumn(
        "flag",
        F.when(F.col("field_key") == "person_name", cross_issue(F.col("value"), F.col("company"))),
    )
    return (
        joined.withColumn("confidence", F.when(F.col("flag").isNotNull(), F.col("confidence") * 0.5).otherwise(F.col("confidence")))
        .withColumn("issue", F.coalesce("flag", "issue"))
        .withColumn("needs_review", F.col("needs_review") | F.col("flag").isNotNull())
        .select(*fields.columns)
    )


def extract_card_fields(blocks: DataFrame) -> DataFrame:
    """blocks(card_id, order_index, text, left, top, right, bottom, confidence) -> fields of every card.

    (stage, first block, pos) is the order in which one card's fields were found. What several passes
    read - pattern hits, free lines, name candidates - is stored once instead of computed per pass.
    """
    lines = measured(blocks)
    patterns = written(extract_patterns(lines))
    claimed = patterns.select("card_id", "order_index").distinct()
    free = written(
        lines.join(claimed, ["card_id", "order_index"], "left_anti").select(
            "card_id", "order_index", "txt", "left", "top", "right", "bottom", "conf", "size",
            looks_like_address(F.col("text")).alias("is_address"),
        )
    )
    sizes = lines.groupBy("card_id").agg(F.max("size").alias("max_size"))
    designation = written(extract_designation(free, sizes))
    shown = evidence(patterns, designation)
    usable = (
        free.filter(~F.col("is_address") & F.length("txt").between(1, NAME_LENGTH))
        .drop("is_address")
        .join(shown, "card_id", "left")
        .filter(~F.coalesce(F.col("order_index") == F.col("title_index"), F.lit(False)))
        .withColumn("has_person", F.coalesce("has_person", F.lit(False)))
        .drop("title_index")
    )
    parts = [patterns.select(*FIELD_COLUMNS), extract_address(free), designation, extract_names(usable)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leftover_blocks(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    claimed = fields.select("card_id", F.explode("block_indices").alias("order_index"))
    return unassigned_blocks(blocks, claimed)


# --- several reading passes of one image ---------------------------------------------------------

CELL = 128.0


def route_scripts(cards: DataFrame) -> DataFrame:
    """Which scripts each pass reads: (requested, primary) -> primary_pass, secondary_pass."""
    common = F.array_intersect("primary_scripts", "requested")
    return cards.withColumn(
        "primary_pass", let(common, lambda c: F.when(F.size(c) == 0, F.col("primary_scripts")).otherwise(c))
    ).withColumn("secondary_pass", F.array_except("requested", "primary_scripts"))


def merge_passes(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary blocks plus the secondary ones not more than half covered by a primary block.

    A block more than half covered has its centre inside the cover, so the candidates of a block are the
    primary boxes touching its centre's grid cell: an equi-join on (card, cell).
    """
    cell = lambda v: F.floor(v / CELL).cast("int")
    cover = (
        primary.select("card_id", *[F.col(c).alias(f"p_{c}") for c in ("left", "top", "right", "bottom")])
        .withColumn("cx", F.explode(F.sequence(cell(F.col("p_left")), cell(F.col("p_right")))))
        .withColumn("cy", F.explode(F.sequence(cell(F.col("p_top")), cell(F.col("p_bottom")))))
    )
    width = F.least("right", "p_right") - F.greatest("left", "p_left")
    height = F.least("bottom", "p_bottom") - F.greatest("top", "p_top")
    own = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    centred = secondary.withColumn("cx", cell((F.col("left") + F.col("right")) / 2)).withColumn(
        "cy", cell((F.col("top") + F.col("bottom")) / 2)
    )
    c, p = centred.alias("c"), cover.alias("p")
    on_cell = (
        (F.col("c.card_id") == F.col("p.card_id")) & (F.col("c.cx") == F.col("p.cx")) & (F.col("c.cy") == F.col("p.cy"))
    )
    covered = (width > 0) & (height > 0) & (own > 0) & (width * height > own * 0.5)
    kept = c.join(p, on_cell & covered, "left_anti").drop("cx", "cy")
    return primary.unionByName(kept)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Numbers blocks top to bottom, left to right within each card."""
    order = Window.partitionBy("card_id").orderBy("top", "left", "text")
    return blocks.withColumn("order_index", F.row_number().over(order) - 1)
