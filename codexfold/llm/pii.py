"""Personal data replaced by keyed surrogates of the same type and format.

Detected are e-mail addresses, IPv4 addresses, telephone numbers, card numbers,
secrets of 32 to 64 hexadecimal digits and names after a title. A surrogate is
drawn from sha2(key, type, value, attempt) and keeps the shape: digits stay
digits, letters stay letters of the same script, vowels vowels; separators, the
first group of a telephone number, valid octets and a valid Luhn digit are kept.
A name keeps its title and its last letter, which carry the gender.

A value is known by its canonical form (lower case, digits without separators),
so all of its spellings and places get one surrogate, each in its own spelling; a
name is mapped word by word, so that "Mr A B" and "Mr B" stay the same person.
Surrogates are checked against each other and against all values of the corpus;
of two equal ones the smaller value keeps it and the other draws again.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import written

# Titles before a name, vowels and consonants by script.
TITLES = "Mr Mrs Ms Miss Mister Herr Frau Señor Señora Monsieur Madame Mme Signor Signora Господин Госпожа Κύριος Κυρία".split()
LETTERS = {
    "latin": ("aeiou", "bcdfghklmnprstvz"),
    "accented": ("áéíóúàèìòùâêîôûäëïöü", "çñßšžčřďťňľśźćłğ"),
    "greek": ("αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ"),
    "cyrillic": ("аеиоуыэюяё", "бвгджзклмнпрстфхцчшщ"),
}
_EDGE = r"(?<![\p{L}\p{N}._%+@-])"
PATTERNS = {
    "email": rf"{_EDGE}[\p{{L}}\p{{N}}._%+-]++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)*\.\p{{L}}{{2,}}",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\p{N})",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?|\(\d{3}\)|\d{3}(?=[.-]\d{3}[.-]\d{4}))(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])\d{4}(?:[ -]?\d{4}){2}(?:[ -]?\d{1,7})(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[a-fA-F]*\d)[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


#: Pools of letters that LETTERS lacks, by script.
OTHER_LETTERS = {
    r"^\p{IsArabic}$": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"^\p{IsHebrew}$": "אבגדהוזחטיכלמנסעפצקרשת",
    r"^\p{IsDevanagari}$": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    r"^\p{IsHangul}$": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
    r"^\p{IsHan}$": "王李张刘陈杨黄赵周吴徐孙马朱胡林郭何高罗郑梁谢宋唐许韩冯邓曹",
    r"^\p{Lu}$": "ABCDEFGHIKLMNOPRSTUVZ",
    r"^\p{L}$": "abcdefghiklmnoprstuvz",
}


def kind_of(mention: Column) -> Column:
    """The type of a mention, by its own shape."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^\d+\.\d+\.\d+\.\d+$") & (F.length(digits) <= 12) & mention.rlike("^" + PATTERNS["ip"] + "$"), "ip")
        .when(mention.rlike(r"^[0-9a-fA-F]{32,64}$"), "secret")
        .when(mention.rlike(r"^\d{4}[ -]?\d{4}[ -]?\d{4}"), "card")
        .when(mention.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def _draw(seed: Column, place: Column, n: int | Column) -> Column:
    """A number below ``n`` for a place of a value, from the value's keyed digest."""
    return F.pmod(F.xxhash64(seed, place), n).cast("int")


def _letter(c: Column, seed: Column, i: Column) -> Column:
    """Another letter of the same script and class, digits for digits, else ``c``; a letter
    without a pool is drawn from one of its script, or else from Latin letters."""
    out = F.when(c.rlike("^[0-9]$"), _draw(seed, i, F.lit(10)).cast("string"))
    for vowels, consonants in LETTERS.values():
        for pool in (vowels, consonants):
            out = out.when(F.instr(F.lit(pool), c) > 0, F.substring(F.lit(pool), _draw(seed, i, F.lit(len(pool))) + 1, F.lit(1)))
    out = out.when(F.instr(F.lit("jqwxy"), c) > 0, F.substring(F.lit("jqwxy"), _draw(seed, i, F.lit(5)) + 1, F.lit(1)))
    for shape, pool in OTHER_LETTERS.items():
        out = out.when(c.rlike(shape), F.substring(F.lit(pool), _draw(seed, i, F.lit(len(pool))) + 1, F.lit(1)))
    return out.otherwise(c)


def _shaped(value: Column, seed: Column, fixed: Column) -> Column:
    """``value`` with every character but those where ``fixed(i)`` drawn anew."""
    places = F.sequence(F.lit(1), F.length(value))
    return F.array_join(F.transform(places, lambda i: F.when(fixed(i), F.substring(value, i, F.lit(1))).otherwise(_letter(F.substring(value, i, F.lit(1)), seed, i))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda t, i: t + F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, doubled(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
        lambda t: F.pmod(t, F.lit(10)),
    )


def _surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """A candidate for a canonical value; attempts beyond 20 grow by letters where the format allows."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, F.lit(str(attempt))), 256)
    n = F.length(value)
    at = F.instr(value, "@")
    tail = F.length(F.substring_index(value, ".", -1))
    email = _shaped(value, seed, lambda i: (i == at) | (i > n - tail))
    email = F.concat(F.lit("x" * (attempt // 20)), email)
    octet = lambda o, i: F.when(F.length(o) == 3, 100 + _draw(seed, i, F.lit(156))).when(F.length(o) == 2, 10 + _draw(seed, i, F.lit(90))).otherwise(_draw(seed, i, F.lit(10))).cast("string")
    if attempt >= 20:  # few values have short octets
        octet = lambda o, i: _draw(seed, i, F.lit(256)).cast("string")
    ip = F.array_join(F.transform(F.split(value, r"\."), octet), ".")
    phone = _shaped(value, seed, lambda i: i == 1)
    card = _shaped(value, seed, lambda i: i == 1)
    body = F.substring(card, F.lit(1), n - 1)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn(value) == 0, F.concat(body, check)).otherwise(card)
    hexed = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.lower(F.hex(_draw(seed, i, F.lit(16))))), "")
    name = _shaped(value, seed, lambda i: i == n)
    name = F.concat(F.expr("''") if attempt < 20 else F.lit("ba" * (attempt // 20)), name)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "secret", hexed).otherwise(name)


def surrogates(values: DataFrame, key: str, max_attempts: int = 200) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): one to one, and no value of its kind.

    Every attempt takes the values still open, so a few short joins do; the driver
    sees whether any is left.
    """
    values = written(values.distinct())
    taken = written(values.select("kind", "value", F.lit(None).cast("string").alias("surrogate")).limit(0))
    open_values = values
    for attempt in range(max_attempts):
        drawn = open_values.select("kind", "value", _surrogate(F.col("kind"), F.col("value"), key, attempt).alias("surrogate"))
        real = values.select("kind", F.col("value").alias("surrogate"))
        free = written(drawn.join(real, ["kind", "surrogate"], "left_anti").join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti"))
        won = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        taken = written(taken.unionByName(won))
        open_values = written(open_values.join(taken, ["kind", "value"], "left_anti"))
        if open_values.isEmpty():
            return taken
    raise ValueError("a format has fewer free values than the corpus needs")


def _words(mention: Column, kind: Column) -> Column:
    """The parts of a mention that are values: the words of a name, else the mention."""
    return F.when(kind == "name", F.expr("slice(split(mention, ' '), 2, 2)")).otherwise(F.array(mention))


def _canonical(part: Column, kind: Column) -> Column:
    digits = F.regexp_replace(part, "[^0-9]", "")
    return F.when(kind.isin("phone", "card"), digits).otherwise(F.lower(part))


def _in_format(part: Column, surrogate: Column, kind: Column) -> Column:
    """A surrogate in the spelling of the part it replaces."""
    gaps = F.split(part, "[0-9]", -1)
    digits = F.concat(F.split(surrogate, ""), F.array(F.lit("")))
    poured = F.array_join(F.zip_with(gaps, F.slice(digits, F.lit(1), F.size(gaps)), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")
    return (
        F.when(kind.isin("phone", "card"), poured)
        .when(part == F.lower(part), surrogate)
        .when(part == F.upper(part), F.upper(surrogate))
        .when(kind == "name", F.initcap(surrogate))
        .otherwise(surrogate)
    )


def pseudonymised(docs: DataFrame, key: str = "codexfold") -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_replaced``, the mentions in the row.

    All columns and rows stay, repeated ones too; a null text stays null, an empty
    one empty, both with 0. A column of that name is replaced. An empty table stays
    empty. ``key`` decides all surrogates: the same key gives the same ones for the
    same corpus.
    """
    columns = [c for c in docs.columns if c != "n_replaced"]
    docs = docs.select(columns)
    text_key = [F.xxhash64("text").alias("_h"), F.crc32(F.col("text").cast("binary")).alias("_c"), F.length("text").alias("_n")]
    hinted = F.coalesce(F.col("text").rlike("[0-9@]|" + "|".join(TITLES)) & F.col("text").rlike(ANY), F.lit(False))
    touched = docs.where(hinted)
    mentions = written(
        touched.select(*text_key, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("m"))
        .groupBy("_h", "_c", "_n").agg(F.first("m").alias("m")).select("_h", "_c", "_n", F.posexplode("m").alias("place", "mention"))
        .withColumn("kind", kind_of(F.col("mention"))).withColumn("parts", _words(F.col("mention"), F.col("kind")))
        .select("_h", "_c", "_n", "place", "mention", "kind", F.posexplode("parts").alias("nth", "part"))
        .withColumn("value", _canonical(F.col("part"), F.col("kind")))
    )
    mapping = surrogates(mentions.select("kind", "value"), key)
    spelled = mentions.join(mapping, ["kind", "value"]).withColumn("new", _in_format(F.col("part"), F.col("surrogate"), F.col("kind")))
    whole = spelled.groupBy("_h", "_c", "_n", "place").agg(
        F.first("kind").alias("kind"), F.first("mention").alias("mention"), F.array_sort(F.collect_list(F.struct("nth", "new"))).alias("new")
    )
    title = F.substring_index("mention", " ", 1)
    said = F.when(F.col("kind") == "name", F.concat_ws(" ", title, F.col("new.new"))).otherwise(F.col("new.new")[0])
    rows = written(
        whole.select("_h", "_c", "_n", F.struct("place", said.alias("said")).alias("s"))
        .groupBy("_h", "_c", "_n").agg(F.array_sort(F.collect_list("s")).alias("said"))
    )
    marked = touched.select("*", *text_key).join(rows, ["_h", "_c", "_n"])
    gaps = F.split("text", ANY, -1)
    new = F.array_join(F.zip_with(gaps, F.concat(F.col("said.said"), F.array(F.lit(""))), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    names = [F.col(c) if c != "text" else new.alias("text") for c in columns]
    changed = marked.select(*names, F.size("said").cast("long").alias("n_replaced"))
    same = docs.where(~hinted).select(*columns, F.lit(0).cast("long").alias("n_replaced"))
    return same.unionByName(changed)
