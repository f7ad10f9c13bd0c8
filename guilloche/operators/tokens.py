"""Serial-number operators on OCR word tables.

A token table has note_id, seq, text, conf, x, y and h. Every ranking ends with ``seq``, so
that the first token seen wins a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guilloche.schemas import DIGIT_FROM, DIGIT_TO, LETTER_FROM, LETTER_TO

# A serial at the start of a token, anywhere in a text, loosely read, and in its printed form.
_SERIAL = r"^([A-Z0-9]{3})(\*?)([0-9OISBJ]{6,7})"
_ANYWHERE = r"([A-Z0-9OISB]{3})\s?([0-9OISB]{6,7})"
_LOOSE = r"[0-9OISB][A-Z08]{2}\s*[0-9OISB]{6,7}"
_PRINTED = r"^[A-Z0-9?]{3} [0-9]{6,7}$"


def ingest_words(words: DataFrame, *, min_conf: float = 0.20) -> DataFrame:
    """Engine output (text, conf 0-1, box of corner points) to tokens: upper case, whole conf, middle height.

    Empty texts and confidences below the floor go.
    """
    xs, ys = F.transform("box", lambda p: p["x"]), F.transform("box", lambda p: p["y"])
    text = F.upper(F.trim("text"))
    low, high = F.array_min(ys).cast("int"), F.array_max(ys).cast("int")
    return words.where((F.length(text) > 0) & (F.col("conf") >= min_conf)).select(
        "note_id", "seq", text.alias("text"), (F.col("conf") * 100).cast("int").alias("conf"), F.array_min(xs).cast("int").alias("x"), F.floor((low + high) / 2).cast("int").alias("y"), F.greatest(high - low, F.lit(1)).alias("h")
    )


def fix_digits(c: Column) -> Column:
    return F.translate(c, DIGIT_FROM, DIGIT_TO)


def fix_letters(c: Column) -> Column:
    return F.translate(c, LETTER_FROM, LETTER_TO)


def confusion_maps(tokens: DataFrame) -> DataFrame:
    """Every token as digits and as letters."""
    return tokens.select("note_id", "seq", fix_digits(F.col("text")).alias("as_digits"), fix_letters(F.col("text")).alias("as_letters"))


def prefix_of(c: Column) -> Column:
    """A clean three-character prefix: digit and two letters, else three digits, else null."""
    mixed = F.concat(fix_digits(F.substring(c, 1, 1)), fix_letters(F.substring(c, 2, 2)))
    digits = fix_digits(c)
    return F.when(F.length(c) != 3, None).when(mixed.rlike("^[0-9][A-Za-z]{2}$"), mixed).when(digits.rlike("^[0-9]{3}$"), digits)


def digits_of(c: Column) -> Column:
    """Six or seven digits after the confusion fixes, else null."""
    return F.when(fix_digits(c).rlike("^[0-9]{6,7}$"), fix_digits(c))


def prefixes(tokens: DataFrame) -> DataFrame:
    return tokens.select("note_id", "seq", prefix_of(F.col("text")).alias("prefix")).where("prefix is not null")


def digit_groups(tokens: DataFrame) -> DataFrame:
    return tokens.select("note_id", "seq", digits_of(F.col("text")).alias("digits")).where("digits is not null")


def single_token(tokens: DataFrame, *, compact: bool = True) -> DataFrame:
    """Tokens that start with a whole serial; an asterisk between its parts is kept. ``compact``: blanks go first."""
    text = F.replace("text", F.lit(" "), F.lit("")) if compact else F.col("text")
    part = lambda k: F.regexp_extract(text, _SERIAL, k)
    found = tokens.select("note_id", "seq", "conf", prefix_of(part(1)).alias("p"), part(2).alias("star"), digits_of(part(3)).alias("d"))
    return found.where("p is not null and d is not null").select("note_id", "seq", F.concat("p", F.when(F.col("star") == "*", "*").otherwise(" "), "d").alias("serial"), F.col("conf").cast("double").alias("conf"))


def _sides(tokens: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    side = lambda s: tokens.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in tokens.columns if c not in keys])
    return side("p"), side("d")


def paired_tokens(tokens: DataFrame) -> DataFrame:
    """A prefix token left of a digit token on the same line, and single tokens as they stand.

    A self-join on the note with a range condition: the few tokens of a note meet each other.
    """
    p, d = _sides(tokens, "note_id")
    p = p.withColumn("prefix", prefix_of(F.col("p_text"))).where("prefix is not null and p_text rlike '^[A-Z0-9]{3}$'")
    d = d.withColumn("digits", digits_of(F.col("d_text"))).where("digits is not null")
    near = (F.col("p_x") < F.col("d_x")) & (F.abs(F.col("p_y") - F.col("d_y")) <= F.greatest("d_h", F.lit(12))) & (F.col("p_seq") != F.col("d_seq"))
    pairs = p.join(d, "note_id").where(near).select("note_id", F.col("d_seq").alias("seq"), F.concat("prefix", F.lit(" "), "digits").alias("serial"), ((F.col("p_conf") + F.col("d_conf")) / 2).alias("conf"), F.col("p_seq").alias("seq2"), F.lit(1).alias("part"))
    return pairs.unionByName(single_token(tokens, compact=False).withColumns({"seq2": F.lit(0), "part": F.lit(2)}))


def two_letter_pairs(tokens: DataFrame) -> DataFrame:
    """As ``paired_tokens`` with prefixes of two letters; the missing digit is shown as a question mark."""
    p, d = _sides(tokens, "note_id")
    p = p.withColumn("letters", fix_letters(F.col("p_text"))).where("length(p_text) = 2 and letters rlike '^[A-Za-z]{2}$'")
    d = d.withColumn("digits", digits_of(F.col("d_text"))).where("digits is not null")
    near = (F.col("p_x") < F.col("d_x")) & (F.abs(F.col("p_y") - F.col("d_y")) <= F.greatest("d_h", F.lit(12))) & (F.col("p_seq") != F.col("d_seq"))
    return p.join(d, "note_id").where(near).select("note_id", F.concat(F.lit("?"), "letters", F.lit(" "), "digits").alias("serial"), ((F.col("p_conf") + F.col("d_conf")) / 2).alias("conf"))


def serials_in_text(lines: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Every serial anywhere in a line of text, with a fixed confidence of 50."""
    pattern = F.lit(_ANYWHERE)
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("p"), F.regexp_extract_all(text, pattern, 2).alias("d"))
    found = lines.select(id_col, F.posexplode(both).alias("nth", "m")).select(id_col, "nth", prefix_of(F.col("m.p")).alias("p"), digits_of(F.col("m.d")).alias("d"))
    return found.where("p is not null and d is not null").select(id_col, "nth", F.concat("p", F.lit(" "), "d").alias("serial"), F.lit(50).alias("conf"))


def cross_variant(tokens: DataFrame) -> DataFrame:
    """A prefix of one variant with the digits of another in the same region, within 1.5 heights."""
    p, d = _sides(tokens, "note_id", "region")
    p = p.withColumn("prefix", prefix_of(F.col("p_text"))).where("prefix is not null and p_text rlike '^[A-Z0-9]{3}$'")
    d = d.withColumn("digits", digits_of(F.col("d_text"))).where("digits is not null")
    near = (F.col("p_x") < F.col("d_x")) & (F.abs(F.col("p_y") - F.col("d_y")) <= F.greatest("p_h", "d_h") * 1.5)
    return p.join(d, ["note_id", "region"]).where(near).select("note_id", "region", F.concat("prefix", F.lit(" "), "digits").alias("serial"), ((F.col("p_conf") + F.col("d_conf")) / 2).alias("conf"))


def candidates(tokens: DataFrame) -> DataFrame:
    """All serial candidates in the order in which they are found; a single token without blank is found twice."""
    first = single_token(tokens).withColumns({"seq2": F.lit(0), "part": F.lit(0)})
    return first.unionByName(paired_tokens(tokens)).withColumn("conf", F.col("conf").cast("int"))


def vote(found: DataFrame) -> DataFrame:
    """The serial of each note that was found most often, then with the most confidence, then first."""
    sums = found.groupBy("note_id", "serial").agg(F.count("*").alias("votes"), F.sum("conf").alias("conf_sum"), F.min(F.struct("part", "seq", "seq2")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("votes"), F.desc("conf_sum"), "first"))
    return sums.withColumn("_k", rank).where("_k = 1").select("note_id", "serial", "votes", "conf_sum")


def independent_vote(tokens: DataFrame, *, min_digits: int = 40, min_prefix: int = 50, lead: float = 1.3) -> DataFrame:
    """Best digits and best prefix of each note, voted on their own; an unclear prefix stays open."""
    t = tokens.select("note_id", "seq", "conf", digits_of(F.col("text")).alias("d"), F.when(F.col("text").rlike("^[A-Z0-9]{3}$"), prefix_of(F.col("text"))).alias("p"))
    by = Window.partitionBy("note_id")
    d = t.where("d is not null").groupBy("note_id", "d").agg(F.sum("conf").alias("s"), F.min("seq").alias("f"))
    d = d.withColumn("_k", F.row_number().over(by.orderBy(F.length("d"), F.desc("s"), "f"))).where("_k = 1").select("note_id", "d", F.col("s").alias("d_score"))
    p = t.where("d is null and p is not null").groupBy("note_id", "p").agg(F.sum("conf").alias("s"), F.min("seq").alias("f"))
    order = by.orderBy(F.desc("s"), "f")
    p = p.withColumns({"_k": F.row_number().over(order), "runner": F.coalesce(F.lead("s").over(order), F.lit(0))}).where("_k = 1").select("note_id", "p", F.col("s").alias("p_score"), "runner")
    j = d.join(p, "note_id", "left")
    clear = F.col("p_score") >= F.greatest(F.col("runner") * lead, F.lit(min_prefix))
    weak = F.col("d_score") < min_digits
    return j.select("note_id", F.when(weak, "FAIL").otherwise("PASS").alias("status"), F.when(weak, None).otherwise(F.concat(F.when(clear, F.col("p")).otherwise("???"), F.lit(" "), "d")).alias("value"), F.col("d_score").alias("digit_score"), F.col("p_score").alias("prefix_score"))


def looks_like_serial(c: Column) -> Column:
    """A serial at the start, one anywhere, or six characters with five digits."""
    return c.rlike(_SERIAL) | c.rlike(_ANYWHERE) | ((F.length(c) >= 6) & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 5))


def serial_tokens(tokens: DataFrame, *, min_conf: int = 25) -> DataFrame:
    compact = F.replace("text", F.lit(" "), F.lit(""))
    return tokens.where((F.col("conf") >= min_conf) & (F.length(compact) > 0) & looks_like_serial(compact))


def serial_region(tokens: DataFrame) -> DataFrame:
    """The largest box (x, y, w, h in a frame of img_w by img_h) of a serial-looking token, padded and clipped."""
    best = serial_tokens(tokens).where("w * h > 0").withColumn("_k", F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc(F.col("w") * F.col("h")), "seq"))).where("_k = 1")
    px, py = F.greatest(F.lit(8), F.expr("w div 20")), F.greatest(F.lit(6), F.expr("h div 8"))
    return best.select("note_id", F.greatest(F.col("x") - px, F.lit(0)).cast("int").alias("x0"), F.least(F.col("x") + F.col("w") + px, F.col("img_w")).cast("int").alias("x1"), F.greatest(F.col("y") - py, F.lit(0)).cast("int").alias("y0"), F.least(F.col("y") + F.col("h") + py, F.col("img_h")).cast("int").alias("y1"))


def serial_check(notes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Status of the serial check of every note: no words and no candidates both fail."""
    words = tokens.groupBy("note_id").agg(F.count("*").alias("words"))
    j = notes.select("note_id").join(words, "note_id", "left").join(vote(candidates(tokens)), "note_id", "left")
    read = F.format_string("Serial read (%dx, sum conf %d)", "votes", "conf_sum")
    return j.select("note_id", F.lit("ocr_serial_number").alias("check_name"), F.when(F.col("serial").isNull(), "FAIL").otherwise("PASS").alias("status"), F.when(F.col("words").isNull(), "No readable text on note").when(F.col("serial").isNull(), "No serial-shaped tokens").otherwise(read).alias("details"), F.col("serial").alias("value"))


def valid_format(serials: DataFrame) -> DataFrame:
    """Whether a serial has the plain printed form; one with an asterisk has not."""
    return serials.withColumn("valid", F.col("serial").rlike(_PRINTED))


def tune_regions(tokens: DataFrame, notes: DataFrame, regions: DataFrame) -> DataFrame:
    """Notes whose serial lies in a candidate's top or bottom region, of all notes that are not reverse sides.

    ``regions``: candidate, y0, y1, x0, x1 as fractions of ``img_h`` and ``img_w`` of the tokens; at most 1000.
    """
    if regions.limit(1001).count() > 1000:
        raise ValueError("more than 1000 candidate regions")
    fronts = notes.where("side <> 'reverse'").select("note_id")
    seen = tokens.join(fronts, "note_id", "left_semi").where(F.col("text").rlike(_LOOSE))
    inside = (F.col("y") >= F.floor(F.col("img_h") * F.col("y0"))) & (F.col("y") < F.floor(F.col("img_h") * F.col("y1"))) & (F.col("x") >= F.floor(F.col("img_w") * F.col("x0"))) & (F.col("x") < F.floor(F.col("img_w") * F.col("x1")))
    hits = seen.join(F.broadcast(regions), inside).groupBy("candidate", "note_id").agg(F.lit(1).alias("one")).groupBy("candidate").agg(F.count("*").alias("hits"))
    total = fronts.agg(F.count("*").alias("total"))
    return regions.select("candidate").distinct().join(hits, "candidate", "left").crossJoin(F.broadcast(total)).select("candidate", F.coalesce("hits", F.lit(0)).alias("hits"), "total")
