"""String functions over the byte view of a word: character classes, tokens, masks and hex floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = "\x01"
#: How many characters a mask letter stands for, and the 33 symbols in their order.
CLASS_SIZE = {"L": 26, "U": 26, "D": 10, "S": 33}
SYMBOLS = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 40
POLICIES = {
    "basic6": lambda w: F.octet_length(w) >= 6,
    "4class8": lambda w: (F.octet_length(w) >= 8) & w.rlike("[a-z]") & w.rlike("[A-Z]") & w.rlike("[0-9]") & w.rlike("[^a-zA-Z0-9]"),
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_view(c: Column | str) -> Column:
    """Each byte of the UTF-8 text as one character; ASCII stays as it is."""
    return F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")


def text_view(c: Column | str) -> Column:
    return F.decode(F.encode(col(c), "ISO-8859-1"), "UTF-8")


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def ascii_upper(c: Column | str) -> Column:
    return F.translate(col(c), LOWER, UPPER)


def structure(c: Column | str) -> Column:
    """L for a-z, U for A-Z, D for 0-9, E for a break, S for any other byte."""
    out = F.regexp_replace(byte_view(c), "[^a-zA-Z0-9\\x01]", "~")
    out = F.regexp_replace(out, "[a-z]", "l")
    out = F.regexp_replace(out, "[A-Z]", "U")
    out = F.regexp_replace(out, "[0-9]", "D")
    return F.translate(out, "~l\x01", "SLE")


def term_key(piece: Column | str) -> Column:
    """The terminal key of a nonterminal: case is kept in the structure, not in the terminal."""
    return F.translate(col(piece), "U", "L")


def tokenize(c: Column | str) -> Column:
    """Breaks between runs of letters, digits and symbols; breaks that are there stay."""
    return F.array_join(F.regexp_extract_all(col(c), F.lit("([A-Za-z]+|[0-9]+|[^A-Za-z0-9\\x01]+)"), 1), BREAK)


def strip_breaks(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(BREAK), F.lit(""))


def runs(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(f"({pattern})"), 1)


def in_case_of(terminal: Column | str, piece: Column | str) -> Column:
    """The terminal with capitals where the nonterminal has U."""
    return F.array_join(
        F.zip_with(F.split(col(terminal), ""), F.split(col(piece), ""), lambda t, p: F.when(p == "U", ascii_upper(t)).otherwise(t)), ""
    )


def combinations(mask: Column | str) -> Column:
    """Strings that a mask of L, U, D and S can make, as a double."""
    out = F.lit(1.0)
    for letter, size in CLASS_SIZE.items():
        out = out * F.pow(F.lit(float(size)), F.length(col(mask)) - F.length(F.replace(col(mask), F.lit(letter), F.lit(""))))
    return out


def generatable(word: Column | str, mask: Column | str) -> Column:
    """Whether a lower-case terminal is among a mask's strings: classes agree, and symbols are among the 33."""
    symbol = F.translate(col(word), SYMBOLS + LOWER + "0123456789", "")
    return (F.length(symbol) == 0) & (structure(word) == col(mask))


def class_digit(c: Column) -> Column:
    """The place of a character in its class."""
    def at(alphabet: str) -> Column:
        return F.instr(F.lit(alphabet), c) - 1

    return F.when(c.rlike("^[a-z]$"), at(LOWER)).when(c.rlike("^[0-9]$"), at("0123456789")).otherwise(at(SYMBOLS))


def class_radix(c: Column) -> Column:
    return F.when(c.rlike("^[a-z]$"), 26).when(c.rlike("^[0-9]$"), 10).otherwise(33)


#: A number of up to 60 digits is two decimals, (hi, lo): hi * 10^30 + lo. Such structs have the numbers' order.
LIMB = 10**30
DECIMAL = "decimal(38,0)"


def _limb() -> Column:
    return F.lit(str(LIMB)).cast(DECIMAL)


def div(a: Column, b: Column) -> Column:
    """The whole part of a quotient that 64 bits can hold."""
    return F.call_function("div", a, b)


def wide(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast(DECIMAL).alias("hi"), lo.cast(DECIMAL).alias("lo"))


def wide_of(n: Column | str) -> Column:
    """A decimal of up to 38 digits as a wide number."""
    return wide(div(col(n), _limb()), col(n) % _limb())


def _wide_step(a: Column, by: Column, plus: Column) -> Column:
    """a * by + plus, for a radix and a digit."""
    low = (a["lo"] * by + plus).cast(DECIMAL)
    return wide(a["hi"] * by + div(low, _limb()), low % _limb())


def wide_less(a: Column, n: Column) -> Column:
    """A wide number less a decimal under 10^30 that isn't larger."""
    low = (a["lo"] - n).cast(DECIMAL)
    return wide(F.when(low < 0, a["hi"] - 1).otherwise(a["hi"]), F.when(low < 0, low + _limb()).otherwise(low))


def wide_plus(a: Column, n: Column) -> Column:
    """A wide number and a decimal under 10^30."""
    return _wide_step(a, F.lit(1), n)


def wide_next(a: Column) -> Column:
    return wide_plus(a, F.lit(1))


def wide_narrow(a: Column) -> Column:
    """As a decimal; null if it has more than 38 digits."""
    return F.when(a["hi"] < 100_000_000, (a["hi"] * _limb() + a["lo"]).cast(DECIMAL))


def wide_double(a: Column) -> Column:
    return F.coalesce(wide_narrow(a).cast("double"), a["hi"].cast("double") * float(LIMB) + a["lo"].cast("double"))


def wide_text(a: Column) -> Column:
    """All digits."""
    return F.when(a["hi"] > 0, F.concat(a["hi"].cast("string"), F.lpad(a["lo"].cast("string"), 30, "0"))).otherwise(a["lo"].cast("string"))


def mask_radix(m: Column) -> Column:
    return F.when(m == "D", 10).when(m == "S", 33).otherwise(26)


def wide_combinations(mask: Column | str) -> Column:
    """Strings that a mask can make, exactly: 33^40 has 61 digits."""
    return F.aggregate(F.split(col(mask), ""), wide(F.lit(0), F.lit(1)), lambda a, m: _wide_step(a, mask_radix(m), F.lit(0)))


def wide_index(word: Column | str) -> Column:
    """The index of a terminal among its mask's strings; the first character is the least significant."""
    return F.aggregate(F.reverse(F.split(col(word), "")), wide(F.lit(0), F.lit(0)), lambda a, c: _wide_step(a, class_radix(c), class_digit(c)))


def unseen_index(word: Column | str) -> Column:
    """The same as a decimal; null if it has more than 38 digits."""
    return F.aggregate(F.reverse(F.split(col(word), "")), wide(F.lit(0), F.lit(0)), lambda a, c: _wide_step(a, class_radix(c), class_digit(c)), wide_narrow)


def wide_string(index: Column | str, mask: Column | str) -> Column:
    """The string at a wide index of a mask: the inverse of wide_index."""
    start = F.struct(wide(col(index)["hi"], col(index)["lo"]).alias("n"), F.lit("").alias("s"))

    def step(a: Column, m: Column) -> Column:
        size = mask_radix(m)
        high = (a["n"]["hi"] % size).cast(DECIMAL)
        low = (high * _limb() + a["n"]["lo"]).cast(DECIMAL)  # under 33 * 10^30
        digit = (low % size).cast("int")
        alphabet = F.when(m == "D", F.lit("0123456789")).when(m == "S", F.lit(SYMBOLS)).otherwise(F.lit(LOWER))
        rest = wide((a["n"]["hi"] - high) / size, (low - digit) / size)
        return F.struct(rest.alias("n"), F.concat(a["s"], F.substring(alphabet, digit + 1, F.lit(1))).alias("s"))

    return F.aggregate(F.split(col(mask), ""), start, step, lambda a: a["s"])


def unseen_string(index: Column | str, mask: Column | str) -> Column:
    """The string at an index of a mask, a whole number of up to 38 digits."""
    return wide_string(wide_of(col(index).cast(DECIMAL)), mask)


def from_hex(c: Column | str) -> Column:
    """A hexadecimal float, with or without 0x, as a double."""
    text = F.when(col(c).rlike("^-?0x"), col(c)).otherwise(F.concat(F.lit("0x"), col(c)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("valueOf"), text).cast("double")


def to_hex(c: Column | str) -> Column:
    """The shortest hexadecimal float of a double."""
    return F.regexp_replace(F.reflect(F.lit("java.lang.Double"), F.lit("toHexString"), col(c)), r"\.0p", "p")


def cutoff_text(n: int) -> str:
    return f"1e-{n}"
