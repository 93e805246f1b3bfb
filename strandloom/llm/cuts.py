"""Texts that were cut off, found by how often their last words go on elsewhere.

All of it is SQL: texts become arrays of words and signs, and trigrams of words,
also with places left open, are counted inside of sentences (another word
follows), before sentence marks and at the ends of blocks and texts. Texts that
were posted many times are counted and scored once and the result goes back to
all their rows, so that copies of a cut text do not vouch for its end. The
trigrams at the end of each text are joined with these counts; a text whose last
trigrams are frequent inside but almost never terminal was cut. A last word that
nobody else wrote, but that begins common words, is half a word; its trigrams
speak by these longer words.

Lengths at which the lengths of a source's texts pile up (the limit of a field)
support this: a text of such a length was cut unless its last trigrams are those
of the ends of texts, or it ends in a full stop, which complete texts do so much
oftener than cut ones that only a high pile outweighs it. Markup that is left open at the end is the only other sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import small, stable

#: Marks that end a sentence (fixed values).
STOPS = ".!?。！？…"
#: Scripts written without blanks, where a character counts as a word (fixed value, Java classes).
UNSPACED = r"぀-ヿ㐀-鿿"
#: Tags and marks that end a line or block; other tags are dropped (fixed values).
BLOCKS = r"(?i)(?=[<\[\n`])(?:<br\s*/?>|</?(?:p|div|blockquote|li|ul|ol|tr|table|pre)(?:\s[^<>]*)?>|\[/?(?:quote|code|list)(?:=[^\]]*)?\]|\n\s*\n|\n[-_=*~]{2,}\s*\n|```)"
#: The same without tags (fixed values).
PARTS = r"\n\s*\n|\n[-_=*~]{2,}\s*\n|```"
TAGS = r"(?i)</?[a-z][^<>]*>|\[/?[a-z]{1,10}(?:=[^\]]*)?\]"
#: Signs behind which a sentence goes on, where they stand alone (fixed values); others, such as smileys, only separate words.
JOINTS = r",;:(\[{«„–—&-"
UNSEEN = r"[\u00AD\u200B-\u200F\u2060\uFEFF]"
TOKENS = (
    rf"[a-z]++(?:['’\p{{L}}\p{{M}}&&[^{UNSPACED}]]++)?|(?!\s)(?:[0-9][\p{{N}}.,e%-]*+|[{STOPS}]++|#stop|[{UNSPACED}]|\p{{L}}['’\p{{L}}\p{{M}}&&[^{UNSPACED}]]*+|\p{{N}}"
    rf"|(?<=[\s\p{{L}}\p{{N}}])[{JOINTS}](?=[\s\p{{L}}\p{{N}}]|$)|[^\s\p{{L}}\p{{N}}{STOPS}]++)"
)
#: First characters of words and of numbers beyond ASCII (fixed values, ranges of code points).
WORDLIKE = (("a", "z"), ("ª", "῿"), ("぀", "鿿"), ("가", "힣"))
#: White space, and signs of which ruled lines are made (fixed values).
BLANKS, RULES = " \t\n\r\f\v", "-_=*~"
#: Marks at a text's end that only stand for more text, and the most characters of one (fixed values).
MARKS, LONGEST_MARK = r"(?i)(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…|more|continued|cont\.)\)|\[(?:more|truncated)\])$", 12
#: Entities that texts are full of (fixed values).
ENTITIES = ("nbsp", "amp", "lt", "gt", "quot", "apos", "#")

#: Gapped trigrams: places of the words, counted back from the last word (0). Those that show the last word come first.
SHAPES = ((2, 1, 0), (1, 0), (0,), (2, 1), (3, 2, 1), (3, 2), (4, 3), (5, 4))
SHOWN = 3
#: Occurrences from which a trigram is heard, bound of its log odds, log odds at which it says nothing, and the sum from which a text is complete.
HEARD, LOUD, SILENT, COMPLETE = 8, 6.0, -1.5, -3.0
#: Last trigrams that are broadcast at most (128 MB), to count no others; beyond, all are counted.
MOST_GRAMS = 2_000_000


def _marked(text: Column) -> Column:
    """``tokens``, with the ends of blocks as ``¶`` and other signs as ``§``."""
    plain = F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("\u00A0"), F.lit(" "))
    plain = F.when(F.octet_length(text) > F.length(text), F.regexp_replace(plain, UNSEEN, "")).otherwise(plain)
    untagged = F.regexp_replace(F.regexp_replace(plain, BLOCKS, " #stop "), TAGS, " ")
    plain = F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit("[")), untagged).otherwise(F.regexp_replace(plain, PARTS, " #stop "))
    got = F.regexp_extract_all(F.lower(plain), F.lit(TOKENS), F.lit(0))

    def named(w: Column) -> Column:
        is_word = F.lit(False)
        for low, high in WORDLIKE:
            is_word = is_word | w.between(low, high + "\U0010FFFF")
        long = (F.length(w) >= 12) & w.rlike("^[acgtn]+$")
        return (
            F.when(is_word, F.when(long, "#dna").otherwise(w)).when(w.isin(list(",;:([{«„–—&-")), w).when(w == "#stop", "¶")
            .when(w.between("0", "9\U0010FFFF"), "#").when(F.left(w, F.lit(1)).isin(list(STOPS)), ".").otherwise("§")
        )

    return F.transform(got, named)


def tokens(text: Column) -> Column:
    """Words in lower case, ``#`` for a number, ``#dna`` for long stretches of nucleotides, ``.`` for sentence and block ends, and signs, those behind which a sentence goes on as they are and others as ``§``."""
    return F.transform(_marked(text), lambda w: F.when(w == "¶", ".").otherwise(w))


def endings(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Texts with what their ends look like: ``key, source, text_hash, sizes, body, body_hash, said, apart``; blank and null texts are left out.

    ``body`` is the text without white space, ruled lines and continuation marks
    at its end; ``said`` tells whether it had a mark that only stands for more
    text, ``apart`` whether dots stood apart from a full stop. A body may be empty.
    """
    without = lambda c, signs: F.rtrim(c, F.lit(signs))
    last = lambda c: F.right(c, F.lit(1))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).rlike(r"[^ \t\n\r\f\x0B]")).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), without(F.col(text), BLANKS).alias("trimmed"))
    unruled = without(F.col("trimmed"), RULES)
    is_rule = last(F.col("trimmed")).isin(list(RULES)) & (F.length("trimmed") - F.length(unruled) >= 5) & without(unruled, " \t").endswith("\n")
    rows = rows.withColumn("ruled", F.when(is_rule, without(unruled, BLANKS)).otherwise(F.col("trimmed")))
    marked = last(F.col("ruled")).isin("]", ")")
    rows = rows.withColumn("mark", F.when(marked, F.length(F.regexp_extract(F.right("ruled", F.lit(LONGEST_MARK)), MARKS, 0))).otherwise(0))
    rows = rows.withColumn("plain", F.when(F.col("mark") > 0, without(F.left("ruled", F.length("ruled") - F.col("mark")), BLANKS)).otherwise(F.col("ruled")))
    undotted = without(F.col("plain"), ".…")
    is_dots = F.col("plain").endswith("…") | F.col("plain").endswith("...")
    rows = rows.withColumn("body", F.when(is_dots, without(undotted, BLANKS)).otherwise(F.col("plain")))
    apart = is_dots & (F.length("body") < F.length(undotted)) & last(F.col("body")).isin(list(STOPS))
    return rows.select(
        "key", "source", F.xxhash64("text").alias("text_hash"), _sizes(F.col("text"), F.col("body")).alias("sizes"), "body", F.xxhash64("body").alias("body_hash"), (F.col("mark") > 0).alias("said"), apart.alias("apart")
    )


def different(ends: DataFrame) -> DataFrame:
    """The different bodies of ``endings``, each once: ``body_hash, length, words, hashes, stops, stopped, lettered, closed, markup, torn``.

    Ends of blocks are ``¶`` among the words, and signs that only separate are
    ``§``, except at the end; ``stops`` counts the sentence marks. The flags tell
    whether the body ends in a sentence mark, in a letter, with a closing tag,
    within markup or within a character.
    """

    def bound(words: Column) -> Column:
        core = F.array_position(F.transform(F.reverse(words), lambda w: w != "§"), F.lit(True)).cast("int")  # the last word from the end, from 1
        return F.slice(words, F.lit(1), F.when(core > 0, F.size(words) - core + 1).otherwise(0))

    body = F.col("body")
    closed = F.right("body", F.lit(24)).rlike(r"(?:</|\[/)[a-zA-Z]{1,20}[>\]]$")
    rows = ends.groupBy("body_hash").agg(F.first("body").alias("body"))
    rows = rows.select(
        "body_hash", F.length("body").alias("length"), F.transform(F.array(_marked(body)), bound)[0].alias("words"), F.right("body", F.lit(1)).rlike(r"\p{L}").alias("lettered"), closed.alias("closed"),
        open_markup(body).alias("markup"), body.endswith("\ufffd").alias("torn"),
    )
    n, stops = F.size("words"), F.size("words") - F.size(F.array_remove("words", F.lit(".")))
    return rows.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "stops": stops, "stopped": F.coalesce(F.get("words", n - 1) == ".", F.lit(False))})


def full_stop_odds(texts: DataFrame) -> float:
    """How many times likelier a complete text ends in a sentence mark than one cut at any character: from which odds of its length such a text was cut."""
    r = texts.agg(F.avg(F.col("stopped").cast("double")).alias("ends"), F.sum("stops").alias("stops"), F.sum("length").alias("length")).first()  # one row
    return r["ends"] * r["length"] / r["stops"] if r["stops"] else 0.0


def field_limits(texts: DataFrame, least: int = 40, times: int = 8, around: int = 15, apart: int = 4) -> DataFrame:
    """Lengths at which a source's texts pile up: ``source, unit, size, odds``, the last being how many times more texts there are than usual.

    A length (in characters or in bytes, with and without white space or
    continuation dots at the end) counts as a limit if the source has
    ``times`` as many different texts of it as of the ``around`` lengths on
    either side on average, and clearly more than chance gives. The ``apart``
    most and least frequent of these lengths do not count for the average, so
    that limits near each other cannot hide each other.
    """
    sizes = texts.select("source", "text_hash", F.explode("sizes").alias("x")).select("source", "text_hash", "x.unit", "x.size").where(F.col("size") >= least)
    counts = sizes.distinct().groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    shifted = counts.select("source", "unit", "n", F.col("size").alias("own"), F.explode(F.sequence(F.col("size") - around, F.col("size") + around)).alias("size"))
    near = shifted.groupBy("source", "unit", "size").agg(F.collect_list(F.when(F.col("own") != F.col("size"), F.col("n"))).alias("ms"))  # at most 2 * around
    same = counts.alias("c").join(near.alias("d"), (F.col("c.source").eqNullSafe(F.col("d.source"))) & (F.col("c.unit") == F.col("d.unit")) & (F.col("c.size") == F.col("d.size")))
    every = F.concat(F.sort_array("ms", asc=False), F.array_repeat(F.lit(0).cast("bigint"), 2 * around - F.size("ms")))
    middle = 2 * (around - apart)
    usual = F.aggregate(F.slice(every, apart + 1, middle), F.lit(0).cast("bigint"), lambda a, x: a + x) / middle
    return same.where((F.col("n") >= times * usual) & (F.col("n") >= usual + 5 * F.sqrt(usual) + 4)).select("c.source", "c.unit", "c.size", (F.col("n") / F.greatest(usual, F.lit(0.5)) - 1).alias("odds"))


def _sizes(text: Column, body: Column) -> Column:
    size = lambda unit, n: F.struct(F.lit(unit).alias("unit"), n.alias("size"))
    return F.array(size("text", F.length(text)), size("body", F.length(body)), size("bytes", F.octet_length(text)))


def at_limit(texts: DataFrame) -> DataFrame:
    """``key, odds`` of texts as long as a limit of their source."""
    limits = field_limits(texts)
    sizes = texts.select("key", "source", F.explode("sizes").alias("x")).select("key", "source", "x.unit", "x.size")
    return sizes.join(limits.withColumnsRenamed({"source": "_source", "unit": "_unit", "size": "_size"}), F.expr("source <=> _source and unit = _unit and size = _size")).groupBy("key").agg(F.max("odds").alias("odds"))


def _shapes(places: list[Column]) -> Column:
    return F.array(*[F.xxhash64(F.lit(n), *[places[p] for p in shape]) for n, shape in enumerate(SHAPES)])


def _hash(word: str) -> Column:
    return F.xxhash64(F.lit(word))


def _after(following: Column, stop: Column, block: Column, sign: Column) -> Column:
    """What follows a word: 0 another word, 1 a sentence mark, 2 the end of a block or text, 3 a sign that tells nothing."""
    return F.when(following.isNull() | (following == block), 2).when(following == stop, 1).when(following == sign, 3).otherwise(0)


def trigram_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, n_inside, n_stop, n_final`` of the wanted trigrams in different texts: how often a word, a sentence mark, and the end of a block or text follow.

    ``wanted`` (``gram``, each once) is broadcast if it is small; else all
    trigrams are counted. Either way they are added up before they are shuffled.
    """
    rows = texts.where(F.size("hashes") > 0).select(F.concat(F.array_repeat(_hash("^"), 5), "hashes").alias("h"), F.size("hashes").alias("n"))
    shifted = [F.slice("h", 6 - p, F.col("n")).alias(f"w{p}") for p in range(6)]
    rows = rows.select(F.inline(F.arrays_zip(*shifted, F.slice("h", F.lit(7), F.col("n")).alias("next")))).where(~F.col("w0").isin(_hash("."), _hash("¶"), _hash("§")))
    words = [F.when(F.col(f"w{p}") == _hash("¶"), _hash(".")).otherwise(F.col(f"w{p}")) for p in range(6)]
    grams = rows.select(_after(F.col("next"), _hash("."), _hash("¶"), _hash("§")).alias("after"), F.explode(_shapes(words)).alias("gram"))
    if wanted.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS:
        grams = grams.join(F.broadcast(wanted), "gram", "left_semi")
    return grams.groupBy("gram").agg(*[F.count_if(F.col("after") == i).alias(c) for i, c in enumerate(("n_inside", "n_stop", "n_final"))])


def last_trigrams(texts: DataFrame) -> DataFrame:
    """``body_hash, shape, gram`` of the different texts that end in a word or sign other than the end of a sentence or block."""
    n = F.size("hashes")
    places = [F.coalesce(F.get("hashes", n - 1 - p), _hash("^")).alias(f"w{p}") for p in range(6)]
    rows = texts.where(n > 0).select("body_hash", *places).where(~F.col("w0").isin(_hash("."), _hash("¶"), _hash("§"), _hash("#dna")))
    words = [F.when(F.col(f"w{p}") == _hash("¶"), _hash(".")).otherwise(F.col(f"w{p}")) for p in range(6)]
    return rows.select("body_hash", F.posexplode(_shapes(words)).alias("shape", "gram"))


def half_words(texts: DataFrame) -> DataFrame:
    """``body_hash, odds`` of the different texts whose last word begins longer words: log odds of the word itself against those, at most ``LOUD`` below 0.

    A word counts where it does not end a block or text, as only there half words stand.
    """
    n = F.size("words")
    pairs = F.arrays_zip(F.col("words").alias("word"), F.slice("words", F.lit(2), n).alias("next"))
    after = _after(F.col("next"), F.lit("."), F.lit("¶"), F.lit("§"))
    both = texts.where(n > 0).select(F.inline(pairs)).where(F.length("word") > 1)
    words = stable(both.groupBy("word").agg(F.count("*").alias("n"), F.count_if(after < 2).alias("n_used")).where(F.col("word").rlike(r"^\p{L}+$")))
    ends = texts.where((n > 0) & F.col("lettered")).select("body_hash", F.get("words", n - 1).alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    starts = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", F.lit(1), i))).alias("word"), "n")
    longer = starts.groupBy("word").agg(F.sum("n").alias("n_longer"))
    known = longer.join(words.select("word", "n_used"), "word", "left")
    odds = F.log((F.coalesce("n_used", F.lit(0)) + 0.5) / (F.col("n_longer") + 0.5))
    return ends.join(known.select("word", F.greatest(odds, F.lit(-LOUD)).alias("odds")), "word").select("body_hash", "odds")


def scores(texts: DataFrame) -> DataFrame:
    """``body_hash, score, half, final`` of the different texts that do not end in a sentence mark.

    ``score`` adds up the log odds of the last trigrams (terminal against
    inside); the text itself does not count. Trigrams that leave out the last
    word are not heard where this word almost only ends texts. In favour of a
    text that ends in half a word (``half``) no trigram is heard, as other cut
    texts end in it, too; its odds count instead.
    ``final`` adds up the odds that blocks or texts end there, and not only
    sentences.
    """
    last = stable(last_trigrams(texts))
    counts = trigram_counts(texts, last.select("gram").distinct())
    heard = last.join(counts, "gram").withColumn("n_final", F.col("n_final") - 1)
    rest = F.col("n_inside") + F.col("n_stop")
    is_heard = rest + F.col("n_final") >= HEARD
    odds = lambda up, down: F.when(is_heard, F.greatest(F.lit(-LOUD), F.least(F.lit(LOUD), F.log((up + 0.5) / (down + 0.5)) - SILENT))).otherwise(0.0)
    says, ends = odds(F.col("n_stop") + F.col("n_final"), F.col("n_inside")), odds(F.col("n_final"), rest)
    shown = F.col("shape") < SHOWN
    added = heard.groupBy("body_hash").agg(
        F.sum(F.when(shown, says).otherwise(0.0)).alias("shown"), F.sum(F.when(~shown, says).otherwise(0.0)).alias("hidden"), F.sum(ends).alias("final"),
        F.max((F.col("shape") == SHAPES.index((0,))) & (ends >= -2 * SILENT)).alias("closes"),
    )
    both = added.join(half_words(texts), "body_hash", "left")
    half = F.coalesce(F.col("odds") < COMPLETE, F.lit(False))
    hidden = F.when(F.col("closes"), F.greatest("hidden", F.lit(0.0))).when(half, F.least("hidden", F.lit(0.0))).otherwise(F.col("hidden"))
    shown = F.when(half, F.least("shown", F.lit(0.0)) + F.col("odds")).otherwise(F.col("shown"))
    score = shown + hidden
    return both.select("body_hash", score.alias("score"), half.alias("half"), "final")


def open_markup(body: Column) -> Column:
    """The text ends within a tag, an entity or a BBCode element: what follows the last opening sign does not close it."""
    after = lambda sign: F.when(F.contains(body, F.lit(sign)), F.substring_index(body, sign, -1))
    tag, code, entity = after("<"), after("["), after("&")
    in_tag = tag.rlike(r"^(?:/?[a-zA-Z][^>\n]*|/|!-*)?$")
    in_code = code.rlike(r"^/?(?:[a-zA-Z]{1,10}(?:=[^\]]*)?)?$")
    in_entity = entity.rlike(r"^(?:#\d*|[a-z]+)$") & F.exists(F.array(*[F.lit(e) for e in ENTITIES]), lambda e: F.startswith(e, F.left(entity, F.length(e))) & (F.length(entity) <= F.length(e) + F.when(e == "#", 6).otherwise(0)))
    line = F.substring_index(body, "\n", -1)
    unclosed = line.rlike(r"(?i)\[(size|url|color|img|font)[^\]]*\](?!.*\[/\1\])") | line.rlike(r"(?i)<(i|b|a|em|span)(\s[^<>]*)?>(?!.*</\1>)[^.!?]*$")
    return F.coalesce(in_tag, F.lit(False)) | F.coalesce(in_code, F.lit(False)) | F.coalesce(in_entity, F.lit(False)) | unclosed


def cut_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Texts that were cut off: ``key, source, reason``.

    ``reason`` is ``limit`` (length of a field's limit, unless the last words
    are those of text ends or end in a full stop while the limit's pile is too
    low for that, or a mark such as ``[...]`` at the end), ``markup``
    (left open), ``word`` (half a word) or ``sentence`` (trigrams that always go
    on, unless a closing tag follows, or dots apart behind a full stop), the
    first that holds. Null,
    empty and blank texts and rows without a key are never cut; a null source
    is a source of its own; repeated rows of a key give one row. Copies of a
    text (the same up to white space and dots at the end) count as one text in
    all counts. An empty table gives no rows.
    """
    ends = stable(endings(docs, key, text, source)).where("length(body) > 0")
    texts = stable(different(ends))
    scored = scores(texts)
    signs = texts.select("body_hash", "markup", "torn", "closed", "stopped").join(scored, "body_hash", "left")
    flags = ends.select("key", "source", "body_hash", "said", "apart").join(at_limit(ends), "key", "left").join(signs, "body_hash")
    is_limit = (F.col("odds") > F.when(F.col("stopped"), full_stop_odds(texts)).otherwise(0.0)) & F.coalesce(F.col("final") <= 0, F.lit(True))
    is_cut = (F.col("score") < COMPLETE) & ~F.col("closed")
    reason = (
        F.when(is_limit | F.col("said"), "limit").when(F.col("markup"), "markup")
        .when((F.col("half") & is_cut) | F.col("torn"), "word").when(is_cut | F.col("apart"), "sentence")
    )
    return flags.select(F.col("key").alias(key), F.col("source").alias(source), reason.alias("reason")).where("reason is not null").dropDuplicates([key])


def cut_rates(docs: DataFrame, cut: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """How often each source cuts: ``source, n_docs, n_cut, share``."""
    all_docs = docs.dropDuplicates([key]).groupBy(source).agg(F.count("*").alias("n_docs"))
    bad = cut.groupBy(source).agg(F.count("*").alias("n_cut")).withColumnRenamed(source, "_s")
    n = F.coalesce("n_cut", F.lit(0)).cast("bigint")
    return all_docs.join(bad, F.col(source).eqNullSafe(F.col("_s")), "left").select(source, "n_docs", n.alias("n_cut"), F.round(n / F.col("n_docs"), 6).alias("share"))
