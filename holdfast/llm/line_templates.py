"""Line dedup with a log-template tree, in DataFrame operations only.

A line's fields with digits become ``<*>``. The tree has fixed depth: its first level is the number of tokens, the next
ones are the leading tokens, so each line reaches its leaf by itself and leaves need no order of arrival. In a leaf a
token is constant at its place when enough documents have it there and variable otherwise; lines with few variable
tokens (in short lines one, beside enough constant ones) share the template that has ``<*>`` for them. A template that recurs in many documents and between different
neighbours is boilerplate, and its lines are dropped.

The neighbours tell boilerplate from copies: a copied document brings its lines' neighbours along, while a licence or
navigation line stands between others in each document. Where they do not (inside a block of boilerplate, beside a fixed
line, beside many edited copies), the texts of a template are counted once per class of copied texts instead. Copies are
left to the document dedup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components, end_links
from holdfast.llm.scratch import dropped, stored
from holdfast.scale import lookup

VARIABLE = "<*>"
LEADING_TOKENS = 3
# A template is dropped when this many different texts have it.
LEAST_TEXTS = 10
# Different pairs of neighbours there must be for each text.
LEAST_NEIGHBOURS = 0.25
# Texts are copies if they share this much of their runs of two words.
COPY_SIMILARITY = 0.5
# They are compared if all min-hashes of one of their keys are equal: 98.6 % of pairs that share two thirds of their runs,
# 80 % of those that share half; a family of copies needs one link a text.
COPY_KEYS = 12
KEY_HASHES = 3
# Texts whose class is asked for sent to every executor, 8 bytes each; more are met by a shuffle of the texts.
BROADCAST_TEXTS = 500_000
# Share of a line's tokens that may be variable besides fields with digits.
MOST_VARIABLE = 0.1
# In shorter lines one token may be, if this many are constant.
LEAST_CONSTANT = 4
# Documents with lines to drop sent to every executor, about 60 bytes each; more are joined by a shuffle of the texts.
BROADCAST_DOCUMENTS = 250_000
# Leaves with recurring lines sent likewise, 16 bytes each; more are met by a shuffle of the lines.
BROADCAST_LEAVES = 500_000


def single_spaced(line: Column) -> Column:
    """The line with single spaces and none at its ends."""
    # Most lines have nothing to replace; searching them costs less than a pattern.
    odd = [F.contains(line, F.lit(gap)) for gap in ("  ", "\t", "\x0b", "\f", "\r", "\n")]
    return F.trim(F.when(reduce(Column.__or__, odd), F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """The line with single spaces and ``<*>`` for every field with a digit."""
    # Tried at the start of a field only, so that one very long field costs no more than its length.
    return F.regexp_replace(single_spaced(line), r"(?<!\S)[^\s\d]*+\d\S*", VARIABLE)


def _path(line: Column) -> Column:
    """The leaf of a single-spaced line; only its leading tokens are masked."""
    size = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    leading = F.transform(F.split(F.substring_index(line, " ", LEADING_TOKENS), " "), lambda t: F.when(t.rlike(r"\d"), VARIABLE).otherwise(t))
    return F.xxhash64(size, leading)


def _entries(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, entries, paths`` per document: its single-spaced lines with a token and their leaves."""
    text = F.coalesce("text", F.lit(""))
    entries = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("line_no"), single_spaced(line).alias("line"))),
                       lambda e: e["line"] != "")
    return (docs.select("doc_id", F.xxhash64(text).alias("text_hash"), entries.alias("entries"))
            .withColumn("paths", F.transform("entries", lambda e: _path(e["line"]))))


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_no, line, path, before, after``: one row per line with a token, its leaf and the leaves
    of the lines with tokens around it (0 for none)."""
    none = F.array(F.lit(0).cast("long"))
    # Neighbours are put beside each line before the rows are made, so a long document costs no more than its length.
    return (_entries(docs)
            .withColumns({"before": F.slice(F.concat(none, "paths"), F.lit(1), F.size("paths")),
                          "after": F.slice(F.concat("paths", none), F.lit(2), F.size("paths"))})
            .select("doc_id", "text_hash", F.inline(F.arrays_zip("entries", "paths", "before", "after")))
            .select("doc_id", "text_hash", "entries.line_no", "entries.line", F.col("paths").alias("path"), "before", "after"))


def template_lines(docs: DataFrame, least_texts: int = LEAST_TEXTS, most_variable: float = MOST_VARIABLE) -> DataFrame:
    """``doc_id, text_hash, line_no, before, after, template`` of the lines whose leaf has ``least_texts`` texts."""
    # Leaves are counted without lines; the texts are read again for the lines in them, as few of all lines are.
    paths = _entries(docs).select("text_hash", F.explode(F.array_distinct("paths")).alias("path"))
    leaves = stored(paths.distinct().groupBy("path").agg(F.count("*").alias("texts"))
                    .where(F.col("texts") >= least_texts), "leaves")
    if leaves.count() <= BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)
    shared = stored(_lines(docs).join(leaves, "path", "left_semi").withColumn("line", masked(F.col("line")))
                    .withColumn("form", F.xxhash64("line")), "shared-lines")

    # The words are needed once per different line of those leaves.
    forms = shared.groupBy("path", "line").agg(F.lit(1).alias("one"))
    counts = shared.select("form", "text_hash").distinct().groupBy("form").agg(F.count("*").alias("texts"))
    forms = stored(forms.withColumn("form", F.xxhash64("line")).join(counts, "form")
                   .select("path", "form", "line", "texts"), "forms")
    tokens = forms.select("path", "form", "texts", F.posexplode(F.split("line", " ")).alias("place", "token"))
    support = stored(tokens.groupBy("path", "place", "token").agg(F.sum("texts").alias("support"), F.count("*").alias("forms"))
                     .where(F.col("support") >= least_texts), "support")
    known = lookup(tokens, support, ["path", "place", "token"], ["support"], size="forms", row_id="form")
    constant = F.col("support").isNotNull()
    parts = F.struct("place", F.when(constant, F.col("token")).otherwise(F.lit(VARIABLE)).alias("token"))
    built = (known.groupBy("path", "form").agg(
        F.array_sort(F.collect_list(parts)).alias("parts"),
        F.sum(F.when(constant | (F.col("token") == VARIABLE), 0).otherwise(1)).alias("variable"),
        F.sum(F.when(constant & (F.col("token") != VARIABLE), 1).otherwise(0)).alias("constant"))
        .withColumn("general", (F.col("variable") <= F.size("parts") * most_variable)
                    | ((F.col("variable") == 1) & (F.col("constant") >= LEAST_CONSTANT))))
    # A line with too many variable tokens is a template of its own.
    template = F.when(F.col("general"), F.xxhash64("path", "parts.token")).otherwise(F.xxhash64("path", "form"))
    sizes = shared.groupBy("form").agg(F.count("*").alias("lines"))
    templates = stored(built.select("form", template.alias("template")).join(sizes, "form"), "templates")
    rows = shared.select("doc_id", "text_hash", "line_no", "before", "after", "form",
                        F.xxhash64("doc_id", "text_hash", "line_no").alias("row"))
    found = lookup(rows, templates, ["form"], ["template"], size="lines", row_id="row")
    marked = stored(found.where("template is not null").drop("form", "row"), "template-lines")
    for table in (shared, forms, support, templates):
        dropped(table)
    return marked


def _runs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text_hash, elements`` of the rows of ``docs`` that ``wanted`` names by ``text_hash`` and, if it has it, ``doc_id``:
    different hashes of two neighbouring words."""
    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    same = rows.text_hash == wanted.text_hash
    if "doc_id" in wanted.columns:
        same &= rows.doc_id.eqNullSafe(wanted.doc_id)
    tokens = rows.join(wanted, same, "left_semi").select("text_hash", F.split(masked(F.col("text")), " ").alias("tokens"))
    # The last token comes before the first, so that a text of one token has a run.
    before = F.concat(F.array(F.element_at("tokens", -1)), F.slice("tokens", F.lit(1), F.size("tokens") - 1))
    return tokens.select("text_hash", F.array_distinct(F.zip_with(before, "tokens", lambda a, b: F.xxhash64(a, b))).alias("elements"))


def copy_classes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text_hash, class`` of those texts ``wanted`` (``text_hash``) that are copies of others in it, edited or not, but
    the least of each class. With a ``doc_id`` beside each text only that row of the text is read.

    Every text that shares a key with others is compared with two of them, the first and the last in an order by hash, and
    linked if it shares ``COPY_SIMILARITY`` of its runs. A family whose texts meet such a one under any of their keys is
    one class; all texts of a key meet the same two, found by a partial aggregate, whatever their number.
    """
    sets = stored(_runs(docs, wanted), "runs")
    # Minima of rows, so that only they travel.
    least = [F.min(F.xxhash64(F.lit(i), "run")).alias(f"h{i}") for i in range(COPY_KEYS * KEY_HASHES)]
    keys = F.array(*[F.xxhash64(F.lit(k), *[f"h{i}" for i in range(KEY_HASHES * k, KEY_HASHES * (k + 1))]) for k in range(COPY_KEYS)])
    keyed = stored(sets.select("text_hash", F.explode("elements").alias("run")).groupBy("text_hash").agg(*least)
                   .select("text_hash", F.explode(keys).alias("key")), "copy-keys")
    sizes = sets.select(F.col("text_hash").alias("same"), F.size("elements").alias("n")).distinct()
    members = stored(keyed.join(sizes, keyed.text_hash == sizes.same).select(F.col("text_hash").alias("node"), F.col("key").alias("bucket"), "n"),
                     "members")
    links = end_links(members, sets.withColumnRenamed("text_hash", "node"), COPY_SIMILARITY)
    roots = components(links)
    for table in (keyed, members, sets):
        dropped(table)
    return roots.select(F.col("node").alias("text_hash"), F.col("root").alias("class"))


def recurring_lines(docs: DataFrame, least_texts: int = LEAST_TEXTS, least_neighbours: float = LEAST_NEIGHBOURS,
                    most_variable: float = MOST_VARIABLE) -> DataFrame:
    """``doc_id, text_hash, line_nos``: the lines to drop of each document that has any, numbered from 0.

    A template goes if it has ``least_texts`` texts between enough different neighbours, or in as many classes of copies.
    """
    lines = template_lines(docs, least_texts, most_variable)
    counted = stored(lines.groupBy("template").agg(
        F.count_distinct("text_hash").alias("texts"), F.count_distinct("before", "after").alias("neighbours"),
        F.count("*").alias("lines")).where(F.col("texts") >= least_texts)
        .withColumn("drop", F.col("neighbours") >= F.greatest(F.lit(least_texts), F.col("texts") * least_neighbours)), "counted")
    rows = lines.withColumn("row", F.xxhash64("doc_id", "text_hash", "line_no"))
    marked = stored(lookup(rows, counted, ["template"], ["drop"], size="lines", row_id="row")
                    .where("drop is not null").select("doc_id", "text_hash", "line_no", "template", "drop"), "marked")
    dropped(lines)
    in_doubt = stored(marked.where("not drop").select("template", "text_hash").distinct(), "in-doubt")
    gone = marked.where("drop")
    if not in_doubt.isEmpty():
        one_row = marked.where("not drop").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
        classes = copy_classes(docs, stored(one_row, "one-row"))
        own = in_doubt.join(classes, "text_hash", "left").select("template", F.coalesce("class", "text_hash").alias("class"))
        recurring = own.groupBy("template").agg(F.count_distinct("class").alias("classes")).where(F.col("classes") >= least_texts)
        facts = stored(recurring.join(counted.select("template", "lines"), "template")
                       .select("template", "lines", F.lit(True).alias("recurs")), "recurring")
        doubtful = marked.where("not drop").withColumn("row", F.xxhash64("doc_id", "text_hash", "line_no"))
        found = lookup(doubtful, facts, ["template"], ["recurs"], size="lines", row_id="row")
        gone = gone.unionByName(found.where("recurs").drop("recurs", "row"))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("line_nos"))


def drop_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns, its text without recurring lines, and ``n_lines``, ``n_dropped`` (which replace
    columns of these names, in any case).

    A NULL text stays NULL and has no lines; an empty text has one, which has no token and stays, like every line of
    white space. No row is dropped, even if all its lines are. Equal texts count as one for recurrence, repeated rows
    are treated alike. An empty table gives no rows.
    """
    drops = stored(recurring_lines(docs, **options), "drops")
    if drops.count() <= BROADCAST_DOCUMENTS:
        drops = F.broadcast(drops)
    own_hash = F.xxhash64(F.coalesce(docs.text, F.lit("")))
    joined = docs.join(drops, docs.doc_id.eqNullSafe(drops.doc_id) & (own_hash == drops.text_hash), "left")
    # A column of its own, as a split inside the lambda would be made again for every line.
    own_lines = "_lines" + "_" * max(map(len, docs.columns))
    joined = joined.withColumn(own_lines, F.split(docs.text, "\n"))
    lines = F.col(own_lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops.line_nos)
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    same = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(
        *[F.when(drops.line_nos.isNull(), docs.text).otherwise(text).alias("text") if c == "text" else docs[f"`{c}`"] for c in same],
        F.coalesce(F.when(docs.text.isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(drops.line_nos), F.lit(0)).cast("long").alias("n_dropped"))
