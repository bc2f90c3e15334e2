"""Personal data replaced by keyed surrogates of the same kind. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import as_text
from gridloom.runtime import cut, free_name, quoted, release, table

# What counts as an entity, by kind (Java patterns). A match belongs to the first kind that fits all of it.
# What may repeat without bound repeats possessively, over single characters or groups without a choice, so that long
# runs take neither stack nor time beyond their length.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PARTICLE = r"(?:(?:von|van|de|del|della|der|den|di|da|dos|du|la|le|zu|zur|ter|ten)[  ]){0,2}"
TOKEN = r"\p{Lu}[\p{L}\p{M}'’-]*+"
TITLES = {
    "male": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин"],
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Госпожа"],
    "person": ["Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор"],
}
#: The next title isn't part of the name before it.
_NO_TITLE = rf"(?!(?:{'|'.join(x for t in TITLES.values() for x in t)})(?!\p{{L}}))"
NAME = rf"[ \u00a0]++{PARTICLE}{_NO_TITLE}{TOKEN}(?:[ \u00a0]{PARTICLE}{_NO_TITLE}{TOKEN})?"
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9]++(?:[.-]++[A-Za-z0-9]++)*+(?![\p{L}\p{N}@])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}]|[.-][0-9])",
    "card": r"(?<![\p{L}\p{N}.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}]|[.-][0-9])",
    **{k: rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(t)})\.?{NAME}" for k, t in TITLES.items()},
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every entity holds one of these, or fits NUMBERS; a cheap first look at each text.
MARKS = ["@", "+", "Mr", "Ms", "Miss", "Mme", "Mlle", "Monsieur", "Madame", "Herr", "Frau", "Sr", "Señor", "Госпо", "Dr", "Doctor", "Prof", "Доктор", "Профессор"]
NUMBERS = r"[0-9][0-9. ()-]{5,}[0-9]|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
# Parts of invented names, by gender and script. No name is in two lists.
GIVEN = {
    ("male", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul".split(),
    ("female", "latin"): "Ada Berta Clara Dora Elena Flora Greta Helga Irma Julia Klara Lena Maria Nora Olga Paula".split(),
    ("person", "latin"): "Alex Robin Kim Sam Sasha Charlie Jamie Taylor Jordan Morgan Casey Riley Noa Jules Quinn Kaya".split(),
    ("male", "cyrillic"): "Адам Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("female", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса".split(),
    ("person", "cyrillic"): "Саша Женя Валя Слава Паша Шура Тоня Миша Стася Лёва Вася Юля Рома Кася Сима Ника".split(),
}
SYLLABLES = {"latin": "ba de fi go lu ma ne ri so tu va we xi zo ka mi".split(), "cyrillic": "ба де фи го лу ма не ри со ту ва ве кси зо ка ми".split()}
ALPHABETS = {"0123456789": ("0", "9"), "abcdefghijklmnopqrstuvwxyz": ("a", "z"), "абвгдежзиклмнопрстуфхцчшэюя": ("Ѐ", "ӿ"), "αβγδεζηθικλμνξοπρστυφχψω": ("Ͱ", "Ͽ")}
#: From this draw on a surrogate of letters or digits gets more of them, so that short ones don't run out.
LONGER_FROM = 3
#: Values with over a share of 1 / HOT of all matches, of which there are HOT at most, are joined by broadcast.
HOT = 1_000
#: What stands around a match in a marked text: a character, then one that says whether it was in the text before.
_ESCAPE, _MARK, _PLAIN = "\u0001", "\u0002", "\u0003"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(text: Column) -> Column:
    """The text cut at its candidate matches: plain, match, plain, match, ..., plain; null for a text without one.

    One scan of the patterns, which marks the matches in place; texts that fail the first look aren't scanned.
    """
    may = text.rlike(NUMBERS)
    for m in reversed(MARKS):
        may = F.contains(text, F.lit(m)) | may
    safe = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _PLAIN))
    marked = F.regexp_replace(safe, f"({ANY})", f"{_ESCAPE}{_MARK}$1{_ESCAPE}{_MARK}")
    back = lambda p: F.replace(p, F.lit(_ESCAPE + _PLAIN), F.lit(_ESCAPE))
    return _once(F.split(F.when(may, marked), _ESCAPE + _MARK, -1), lambda parts: F.when(F.size(parts) > 1, F.transform(parts, back)))


def chars(value: Column) -> Column:
    """The characters of a value, each a code point."""
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum modulo 10 over the digits, every second from the right doubled."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when((F.length(digits) - i) % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10


def _mod97(iban: Column) -> Column:
    """An IBAN (lower case, no spaces) as a number modulo 97: the first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 87) % 97)
    return F.aggregate(chars(turned), F.lit(0), step)


def kind_of(value: Column) -> Column:
    """The kind of a match; null for one that its checks rule out: a card number with a wrong check digit, an address
    whose host ends in no name."""
    fits = {k: value.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    fits["email"] = value.rlike(r"[\p{L}\p{N}_%+-]@") & value.rlike(r"^[._%+-]*+[\p{L}\p{N}]") & value.rlike(r"\.[A-Za-z][A-Za-z0-9-]++$")
    fits["card"] = fits["card"] & (_luhn(digits_of(value)) == 0)
    out = None
    for k, fit in fits.items():
        out = F.when(fit, k) if out is None else out.when(fit, k)
    return out


_TITLE = r"^\S+?[  ]+"
_LEAD = r"^[._%+-]*"


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _named(value: Column) -> tuple[Column, Column]:
    """Given and family name after the title; the given name is empty where there is one name only."""
    rest = F.regexp_replace(value, _TITLE, "")
    given = F.regexp_extract(rest, rf"^{PARTICLE}({TOKEN})[  ]", 1)
    return F.lower(given), F.lower(F.regexp_extract(rest, rf"({TOKEN})$", 1))


def parts_of(value: Column, kind: Column) -> Column:
    """array<struct<slot, kind, scope, canon>>: the entities that a match names, by what all spellings share.

    A name is a given name (scope: gender and script) and a family name (scope: script), so "Mr John Smith", "Mr Smith"
    and "Mrs Smith" share the family name. An address is a mailbox (scope: its host) and a host. Numbers are their
    digits, without a leading 1 where eleven start so. Only entities of one kind and scope compete for surrogates.
    """
    given, family = _named(value)
    part = lambda slot, kind, scope, canon: F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), scope.alias("scope"), canon.alias("canon"))
    low, none = F.lower(value), F.lit("")
    box, host = F.regexp_replace(F.substring_index(low, "@", 1), _LEAD, ""), F.substring_index(low, "@", -1)
    digits = F.when((kind == "phone") & digits_of(value).rlike("^1[0-9]{10}$"), F.substring(digits_of(value), F.lit(2), F.lit(10))).otherwise(digits_of(value))
    name = F.filter(F.array(part("given", "given", F.concat_ws(" ", kind, _script(given)), given), part("family", "family", _script(family), family)), lambda p: p["canon"] != "")
    mail = F.array(part("given", "mailbox", host, box), part("family", "host", none, host))
    single = lambda canon: F.array(part("given", kind, none, canon))
    return F.when(kind.isin(*TITLES), name).when(kind == "email", mail).when(kind.isin("phone", "card", "ssn"), single(digits)).when(kind == "iban", single(F.replace(low, F.lit(" ")))).otherwise(single(low))


def _at(stream: Column, i: Column | int, n: int) -> Column:
    """A number below n that depends on the stream and the place."""
    return F.pmod(F.xxhash64(stream, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def _pick(options: list[str], stream: Column, i: Column | int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), _at(stream, i, len(options)) + 1)


def _letters(canon: Column, stream: Column) -> Column:
    """Each letter and digit of ``canon`` replaced by one of its script and class; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        out = None
        for alphabet, (first, last) in ALPHABETS.items():
            new = F.substring(F.lit(alphabet), _at(stream, i, len(alphabet)) + 1, F.lit(1))
            out = F.when(c.between(first, last), new) if out is None else out.when(c.between(first, last), new)
        latin = "abcdefghijklmnopqrstuvwxyz"
        return out.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(F.lit(latin), _at(stream, i, 26) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars(canon), one), "")


def _surrogate(kind: Column, scope: Column, canon: Column, turn: Column, key: str) -> Column:
    """A candidate for an entity, in lower case: another for each turn, and longer ones where a kind may run out."""
    seed = F.sha2(F.concat_ws(_ESCAPE, F.lit(key), kind, F.when(kind == "mailbox", scope).otherwise(""), canon, turn.cast("string")), 256)

    def draw(stream: Column) -> Column:
        more = F.when(turn >= LONGER_FROM, F.array_join(F.transform(F.sequence(F.lit(LONGER_FROM), turn), lambda i: _at(stream, -i, 10).cast("string")), "")).otherwise("")
        changed = _letters(canon, stream)
        last = F.regexp_extract(canon, r"(\.[^.]*)$", 1)
        host = F.concat(F.substring(changed, F.lit(1), F.length(canon) - F.length(last)), more, last)
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_at(stream, i, 254) + 1).cast("string")), ".")
        card = F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(changed, F.lit(2), F.length(canon) - 2))
        card = _once(card, lambda c: F.concat(c, ((10 - _luhn(F.concat(c, F.lit("0")))) % 10).cast("string")))
        lead = F.greatest(F.lit(0), F.length(canon) - 10)
        phone = F.concat(F.substring(canon, F.lit(1), lead), F.substring(changed, lead + 1, F.length(canon)), more)
        country, account = F.substring(canon, F.lit(1), F.lit(2)), F.substring(changed, F.lit(5), F.length(canon))
        iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)

        def family(script: str) -> Column:
            syllables = F.sequence(F.lit(1), F.lit(4) + F.floor(turn / LONGER_FROM).cast("int"))
            return F.array_join(F.transform(syllables, lambda i: _pick(SYLLABLES[script], stream, i)), "")

        def given(names: list[str]) -> Column:
            return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), turn), lambda i: _pick(names, stream, i)), "-"))

        first = None
        for (gender, script), names in GIVEN.items():
            fits = scope == f"{gender} {script}"
            first = F.when(fits, given(names)) if first is None else first.when(fits, given(names))
        out = F.when(kind == "mailbox", F.concat(changed, more)).when(kind == "host", host).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban)
        return out.when(kind == "family", F.when(scope == "cyrillic", family("cyrillic")).otherwise(family("latin"))).when(kind == "given", first).otherwise(changed)

    return _once(seed, draw)


def _cased(original: Column, new: Column) -> Column:
    """``new`` in the case of the characters of ``original`` at the same places."""
    return F.array_join(F.zip_with(chars(original), chars(new), lambda a, b: F.when(a.rlike(r"\p{Lu}"), F.upper(b)).otherwise(F.coalesce(b, F.lit("")))), "")


def _formatted(value: Column, kind: Column, given: Column, family: Column) -> Column:
    """The surrogates in the format of one spelling: its separators, title, particles, country code and case."""
    title, rest = F.regexp_extract(value, f"({_TITLE})", 1), F.regexp_replace(value, _TITLE, "")

    def named(old: Column, new: Column) -> Column:
        shown = F.array_join(F.transform(F.split(new, "-"), F.initcap), "-")
        return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).otherwise(shown)

    rest = F.regexp_replace(rest, F.lit(rf"{TOKEN}$"), named(F.regexp_extract(rest, rf"({TOKEN})$", 1), family))
    first = rf"^({PARTICLE}){TOKEN}(?=[  ])"
    rest = F.when(given.isNotNull(), F.regexp_replace(rest, F.lit(first), F.concat(F.lit("$1"), named(F.regexp_extract(rest, rf"^{PARTICLE}({TOKEN})", 1), given)))).otherwise(rest)
    box, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    lead = F.regexp_extract(box, f"({_LEAD})", 1)
    mail = F.concat(lead, _cased(F.regexp_replace(box, _LEAD, ""), given), F.lit("@"), _cased(host, family))
    kept = F.greatest(F.lit(0), F.length(digits_of(value)) - F.length(given))  # digits before those of the surrogate
    upto = lambda i: F.length(digits_of(F.substring(value, F.lit(1), i))) - kept
    places = F.sequence(F.lit(1), F.length(value))
    put = lambda i: F.when(F.substring(value, i, F.lit(1)).rlike("[0-9]") & (upto(i) > 0), F.substring(given, upto(i), F.lit(1))).otherwise(F.substring(value, i, F.lit(1)))
    numbers = F.concat(F.array_join(F.transform(places, put), ""), F.substring(given, F.length(digits_of(value)) + 1, F.length(given)))
    bare = lambda i: F.length(F.replace(F.substring(value, F.lit(1), i), F.lit(" ")))
    iban = F.array_join(F.transform(places, lambda i: F.when(F.substring(value, i, F.lit(1)) == " ", " ").otherwise(F.upper(F.substring(given, bare(i), F.lit(1))))), "")
    return F.when(kind.isin(*TITLES), F.concat(title, rest)).when(kind == "email", mail).when(kind.isin("phone", "card", "ssn"), numbers).when(kind == "iban", iban).otherwise(given)


ENTITY = ["kind", "scope", "canon"]


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, scope, canon, sur) for distinct (kind, scope, canon): no two of a kind and scope share one, and none is
    an entity of the input.

    Candidates are keyed hashes. Of those that collide the one with the least canonical form keeps it, the others and
    those that equal a real entity draw again, until none is left. Each round is one aggregate and joins on distinct
    keys over what is not settled, written to the shared folder.
    """
    spark = entities.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = ["kind", "scope", "sur"]
    real = entities.select("kind", "scope", F.col("canon").alias("sur"))
    pending, settled, made = entities.withColumn("turn", F.lit(0)), None, []
    while True:
        drawn = pending.repartition(parts, *ENTITY).withColumn("sur", _surrogate(*(F.col(c) for c in (*ENTITY, "turn")), key))
        new = cut(drawn, "candidates")
        free = new.groupBy(*taken).agg(F.min("canon").alias("canon")).join(real, taken, "left_anti")
        if settled is not None:
            free = free.join(settled.select(*taken), taken, "left_anti")
        won = cut(free.select(*ENTITY, "sur"), "settled")
        lost = cut(new.join(won, ENTITY, "left_anti").select(*ENTITY, (F.col("turn") + 1).alias("turn")), "pending")
        made += [new, pending]
        settled = won if settled is None else settled.unionByName(won)
        if lost.isEmpty():
            release(*made, lost)
            return settled
        pending = lost


def _known(values: DataFrame) -> DataFrame:
    """(value, slot, kind, scope, canon): given names after a title of no gender take the gender that the same name has
    after other titles, where that is one."""
    each = cut(values.select("value", F.inline(parts_of(F.col("value"), F.col("kind")))), "parts")
    open_ = (F.col("kind") == "given") & F.startswith("scope", F.lit("person"))
    gendered = each.where((F.col("kind") == "given") & ~open_).groupBy("canon").agg(F.min("scope").alias("a"), F.max("scope").alias("b")).where("a = b")
    resolved = each.where(open_).join(gendered.select("canon", "a"), "canon", "left").select("value", "slot", "kind", F.coalesce("a", "scope").alias("scope"), "canon")
    return each.where(~open_).unionByName(resolved)


def replacements(occurrences: DataFrame, key: str) -> DataFrame:
    """(value, n, sur) of the distinct values of (value): how often each occurs and what to put for it (not null)."""
    counted = occurrences.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    parts = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = cut(counted.repartition(parts, "value").withColumn("kind", kind_of(F.col("value"))).where("kind is not null"), "values")
    known = cut(_known(values), "entities")
    drawn = surrogates(known.select(*ENTITY).distinct(), key)
    named = known.join(drawn, ENTITY).groupBy("value").agg(*[F.max(F.when(F.col("slot") == s, F.col("sur"))).alias(s) for s in ("given", "family")])
    put = values.join(named, "value").repartition(parts, "value")
    return cut(put.select("value", "n", _formatted(F.col("value"), F.col("kind"), F.col("given"), F.col("family")).alias("sur")), "replacements")


def replace(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """``docs`` with each entity in the text replaced; everything else in the text, and all other columns, stay.

    The same entity gets the same surrogate in all rows, in the format of each spelling, and different entities get
    different ones; see ``parts_of`` for what is one entity. Names count after a title only: the same name without one
    stays. The whole text is scanned, whatever its length, in time in proportion to it. Null texts stay null; empty
    texts and an empty table have no entity. Repeated rows and keys don't matter, as rows are numbered here; columns
    may have any name. counted: name of a column for the number of replaced entities (underscores where it is taken).

    The texts are scanned once and written with their matches cut out. Of texts with a match, the matches are joined
    with their surrogates by value, then gathered by row, so no key is hot but values that many rows share: those with
    over a thousandth of all matches, at most a thousand, are joined by broadcast. Other texts are never shuffled.
    """
    parts, row, there, subs, n_ = (free_name(docs, x) for x in ("_pieces", "_row", "_there", "_surrogates", "_replaced"))
    found = docs.withColumn(parts, pieces(quoted(text).cast("string")))
    found = cut(found.withColumn(row, F.monotonically_increasing_id()).withColumn(text, F.when(quoted(parts).isNull(), quoted(text).cast("string"))), "pieces")
    some, none = found.where(quoted(parts).isNotNull()), found.where(quoted(parts).isNull())
    each = some.select(quoted(row).alias("row"), F.posexplode(quoted(parts)).alias("at", "value")).where("at % 2 = 1")
    puts = replacements(each.select("value"), key)
    total = puts.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = F.col("n") * HOT > total
    hot, cold = F.broadcast(puts.where(often).select("value", "sur")), puts.where(~often).select("value", "sur")
    met = each.join(hot, "value").unionByName(each.join(hot.select("value"), "value", "left_anti").join(cold, "value", "left"))
    in_order = F.sort_array(F.collect_list(F.struct("at", F.coalesce("sur", "value").alias("put"))))["put"]
    by_row = met.groupBy("row").agg(in_order.alias(subs), F.count("sur").alias(n_)).withColumnRenamed("row", there)
    hit = some.join(by_row, quoted(row) == quoted(there))
    plain = F.filter(quoted(parts), lambda _, i: i % 2 == 0)
    whole = F.array_join(F.zip_with(plain, quoted(subs), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    number = [free_name(docs, counted)] if counted else []
    changed = hit.select(*[whole.alias(c) if c == text else quoted(c) for c in docs.columns], *[quoted(n_).alias(n) for n in number])
    same = none.select(*[quoted(c) for c in docs.columns], *[F.lit(0).cast("long").alias(n) for n in number])
    return same.unionByName(changed)


KEY = "surrogates-of-this-corpus"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", as_text(F.col("text")).alias("text"))
    return replace(docs, KEY, counted="n_replaced")
