"""Benchmark decontamination by templates.

Texts are canonicalised word by word: numbers, names (capitalised words inside a sentence) and units after a number
become typed placeholders, punctuation goes, letters are lower-cased. Every window of ``WIDTH`` words of the documents
is hash-joined with the benchmark's by its template. A benchmark window in which fewer than ``LITERAL`` words are no
placeholders says too little: there runs of ``VERBATIM`` words from a slot on are joined by the words themselves. An
item of fewer than ``WIDTH`` words is one window of its own length. So any common run of ``WIDTH`` words is met, in its
own words if it has too few beside its slots.

Each meeting fixes an alignment of document and item; there the templates are compared word by word. Slots must be
consistent: an old value that stands for several new ones counts for the first of them only, and where more than a
quarter of the slots conflict the meeting is by chance, unless nine in ten words are the very same. A question with
other names and numbers still has one new value for each old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import row_key, text_or_empty, written
from trisettle.llm.spans import let

WIDTH = 8
#: Matching words that make a document contaminated (an item with fewer than twice as many needs half of its words).
LEAST = 10
#: Words of a window that are no placeholders, from which its template is used.
LITERAL = 4
#: Words of a run from a slot on: a window of fewer than LITERAL other words holds such a run.
VERBATIM = WIDTH - LITERAL + 1
#: Items of fewer words say too little inside a longer text: a document must be the item.
ALONE = 4
GAP = r"[\x20\x09-\x0D]"
# Number words, units, and private characters that stand for placeholders.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty fifty hundred thousand million".split()
UNITS = ("mm cm km m mg kg g ml l s ms min h minute minutes hour hours day days week weeks month months year years second seconds mile miles "
         "meter meters metre metres feet inches dollar dollars euro euros cent cents degree degrees percent").split()
NAME, NUMBER, UNIT = "", "", ""
#: A capitalised word after a small letter, a comma or a semicolon; the cheap test stands first.
NAMES = r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})[\p{L}'-]+"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}{NAME}\x20\x09-\x0D]+"


def words_of(text: Column, names: bool) -> Column:
    """Words in lower case without punctuation, a name behind ``NAME``; empty where only punctuation stood."""
    marked = F.regexp_replace(text, NAMES, f"{NAME}$0") if names else text
    return F.array_remove(F.split(F.regexp_replace(F.lower(marked), PUNCTUATION, ""), GAP), "")


def template(words: Column) -> Column:
    """The template word for each word: a slot's begins with its placeholder."""

    def word(x: Column, i: Column) -> Column:
        digits = lambda w: (w >= "0") & (w < ":")
        previous = F.get(words, i - 1)
        return (F.when(x >= NAME, NAME).when(digits(x), F.concat(F.lit(NUMBER), F.translate(x, "0123456789", "")))
                .when(x.isin(NUMBER_WORDS), NUMBER)
                .when(x.isin(UNITS), F.when(digits(previous) | previous.isin(NUMBER_WORDS), UNIT).otherwise(x)).otherwise(x))

    return F.transform(words, word)


def slot(template_word: Column) -> Column:
    return template_word >= NAME


def windows(rows: DataFrame, widths: list[int]) -> DataFrame:
    """``rows`` with ``words`` to a row (hash, width, at beside the other columns) for every window of each width, by
    its template, and for every run of ``VERBATIM`` words from a slot on, by the words (width 0).

    Words are hashed once each; a window's hash is that of a slice of them, in generated code, row after row.
    """
    keep = [c for c in rows.columns if c != "words"]
    # the lowest bit of a template word's hash tells slots
    own = lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR(slot(x).cast("long"))
    hashes = F.concat(F.transform(template(F.col("words")), own), F.transform("words", lambda x: F.xxhash64(x)))
    rows = rows.filter(F.size("words") > 0).select(*keep, F.size("words").alias("n"), hashes.alias("hashes"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") * (len(widths) + 1) - 1)).alias("j"))
    at = F.floor(F.col("j") / (len(widths) + 1)).cast("int")
    width = F.element_at(F.array(*map(F.lit, [0, *widths])), F.col("j") % (len(widths) + 1) + 1)
    rows = rows.select(*keep, "n", "hashes", at.alias("at"), width.alias("width"))
    verbatim, size = F.col("width") == 0, F.when(F.col("width") == 0, VERBATIM).otherwise(F.col("width"))
    first = F.col("at") + F.when(verbatim, F.col("n")).otherwise(0) + 1
    rows = rows.filter((F.col("at") + size <= F.col("n")) & (~verbatim | (F.get("hashes", F.col("at")).bitwiseAND(F.lit(1)) == 1)))
    return rows.select(*keep, F.xxhash64("width", F.slice("hashes", first, size)).alias("hash"), "width", "at")


def items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Each item in two forms: with names as placeholders, and without for documents that lost their capitals."""
    rows = benchmark.select(F.col(item).alias("item_id"), text_or_empty(text).alias("text"))
    forms = [rows.select("item_id", F.lit(int(names)).alias("form"), words_of(F.col("text"), names).alias("item")) for names in (True, False)]
    return forms[0].unionByName(forms[1]).filter(F.size("item") > 0).distinct()


def index(forms: DataFrame) -> DataFrame:
    """Windows of the items with enough words of their own, runs from a slot on in other windows; a shorter item is one
    window."""
    rows = forms.select("item_id", "form", F.size("item").alias("n_words"), "item", F.col("item").alias("words"))
    found = windows(rows, list(range(1, WIDTH + 1)))
    slots = lambda first, size: F.size(F.filter(template(F.slice("item", first, size)), slot))
    poor = lambda first: slots(first, WIDTH) > WIDTH - LITERAL
    around = F.sequence(F.greatest(F.col("at") + VERBATIM - WIDTH, F.lit(0)) + 1, F.least(F.col("at"), F.greatest(F.col("n_words") - WIDTH, F.lit(0))) + 1)
    right = F.when(F.col("width") == 0, (F.col("n_words") < WIDTH) | ((F.col("n_words") >= WIDTH) & F.exists(around, poor)))
    right = right.otherwise((F.col("width") == F.least("n_words", F.lit(WIDTH))) & ~((F.col("width") == WIDTH) & poor(F.col("at") + 1)))
    return found.filter(right).select("item_id", "form", "n_words", "hash", "width", F.col("at").alias("item_at")).distinct()


def judged(hit: Column) -> Column:
    """How a part of a document (``part``, its first word aligned to ``skip`` of the item) matches the item."""
    item, part, skip = hit["item"], hit["part"], hit["skip"]

    def compared(both: Column) -> Column:
        def counted(same: Column) -> Column:
            slots = F.filter(same, lambda x: slot(x["t"]))
            clash = lambda x, i: F.exists(F.slice(slots, 1, i), lambda y: (y["old"] == x["old"]) & (y["new"] != x["new"]))
            verbatim = F.size(F.filter(same, lambda x: x["old"] == x["new"]))
            return let(F.size(F.filter(slots, clash)), lambda bad: F.struct(
                (F.size(same) - bad).alias("matched"), ((4 * bad <= F.size(slots)) | ((verbatim >= LEAST) & (10 * verbatim >= 9 * F.size(same)))).alias("consistent"),
                F.exists(slots, lambda x: x["old"] != x["new"]).alias("reparameterised")))

        return let(F.filter(both, lambda x: x["t"] == x["u"]), counted)

    old, new = template(item), template(part)
    rows = let(F.struct(old.alias("old"), new.alias("new")), lambda t: F.transform(part, lambda w, i: F.struct(
        F.get(t["old"], i + skip).alias("t"), t["new"][i].alias("u"), F.get(item, i + skip).alias("old"), w.alias("new"))))
    return let(rows, compared)


def matched(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, matched (words), n_words (of the item) and
    reparameterised (a slot has another value).

    Null and empty texts match nothing; an item of fewer than ``WIDTH`` words needs all of them, one of fewer than
    ``ALONE`` a document of nothing else; a null doc_id matches nothing; repeated rows and items give one row; texts are
    taken whole; extra columns are ignored; an empty table on either side gives an empty result. Ties between
    alignments: the one with most matching words counts.

    Both lookups join written tables, whose size Spark knows: it broadcasts them below its own threshold and
    shuffles beyond it.
    """
    forms = written(items(benchmark, item, item_text), "benchmark-forms")
    known = written(index(forms), "benchmark-windows")
    short = [r.width for r in known.filter(F.col("width").between(1, WIDTH - 1)).select("width").distinct().collect()]  # WIDTH - 1 rows at most
    texts = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    words = words_of(F.col("text"), True).alias("words")
    found = windows(texts.select("doc_id", words), [*sorted(short), WIDTH]).join(known, ["hash", "width"])
    hits = found.select("doc_id", "item_id", "form", "n_words", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    meetings = written(hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "form", "n_words", "shift")).alias("hits")), "benchmark-hits")

    # each hit takes its part of the document along, not the whole
    def cut(h: Column) -> Column:
        skip = F.greatest(-h["shift"], F.lit(0))
        return h.withField("skip", skip).withField("size", F.size("words")).withField("part", F.slice("words", F.greatest(h["shift"], F.lit(0)) + 1, h["n_words"] - skip))

    pairs = texts.join(meetings, "doc_id").select("doc_id", words, "hits").select("doc_id", F.inline(F.transform("hits", cut))).join(forms, ["item_id", "form"])
    rows = pairs.select("doc_id", "item_id", "n_words", "size", judged(F.struct("item", "part", "skip")).alias("x"))
    whole = F.col("x.matched") == F.col("n_words")
    enough = (F.col("x.matched") >= LEAST) | (F.when(F.col("n_words") >= WIDTH, 2 * F.col("x.matched") >= F.col("n_words")).otherwise(whole & ((F.col("n_words") >= ALONE) | (F.col("size") == F.col("n_words")))))
    return (rows.filter(enough & F.col("x.consistent"))
            .groupBy("doc_id", "item_id").agg(F.max(F.struct("x.matched", "n_words", (~F.col("x.reparameterised")).alias("same"))).alias("best"))
            .select("doc_id", "item_id", F.col("best.matched").cast("long").alias("matched"), F.col("best.n_words").cast("long").alias("n_words"), (~F.col("best.same")).alias("reparameterised")))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; rows are told apart by key and text, so a repeated or missing key makes
    no difference. All else is as ``matched`` has it."""
    keyed = docs.withColumn("_row", row_key(key, text))
    bad = written(matched(keyed, benchmark, "_row", text).select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    return keyed.join(bad, "_row", "left_anti").select(*docs.columns)
