"""Surrogates for personal data, in DataFrame functions alone.

Entities are detected by kind, brought to a canonical form, and mapped by a keyed hash to a surrogate of the same kind
and shape: letters to letters of their script (vowels to vowels), digits to digits, card and bank account numbers to
ones with a right checksum, private addresses to private ones, given names to given names of their gender and script.
The surrogates of all entities are checked against each other and against all real entities, and drawn again until
each is new; so different entities stay different, one entity gets one surrogate in every document and spelling, and
none is somebody's real data.

A person is found by a full form: a listed given name before a capitalised word, or a title or cue before one. The
words of the full forms of a text are its names, and every later mention of one of them alone is replaced alike.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnstide.llm.shared import ascii_lower, settle, spread, whole_row

#: Fixed word lists: given names by script and gender, each mapped within its own list. A parameter of replace_pii.
GIVEN = {
    "latin_f": "Aisha Alice Amelia Anita Anna Anjali Carla Carmen Charlotte Claire Clara Elena Emily Emma Fatima Giulia Hannah Helen Ines Isabelle Julia Laura Layla Linda Lucia Maria Marie Martha Mary Mei Nina Olivia Patricia Priya Rosa Sakura Sarah Sofia Susan Ursula Yuki".split(),
    "latin_m": "Ahmed Albert Alexander Ali Antonio Arjun Carlos Charles Daniel David Edward Felix Francesco Georg Henry Hiroshi Ibrahim Jack James Jean Johann John Jorge Juan Karl Kenji Louis Luca Manuel Martin Michael Mohammed Oliver Paul Peter Pierre Rahul Robert Sanjay Thomas Wei William".split(),
    "cyrillic_f": "Александра Анастасия Анна Валентина Вера Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана София Татьяна Юлия".split(),
    "cyrillic_m": "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Максим Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    "greek_f": "Αικατερίνη Άννα Βασιλική Γεωργία Ειρήνη Ελένη Ευαγγελία Μαρία Σοφία".split(),
    "greek_m": "Αλέξανδρος Αντώνης Γιώργος Δημήτρης Ιωάννης Κώστας Μιχάλης Νίκος Παναγιώτης".split(),
}
#: Fixed words before a name: titles, with a dot or without, and cues.
TITLES = "Doktor Dr Frau Herr Madame Miss Mlle Mme Monsieur Mr Mrs Ms Prof Professor Señor Señora Signor Signora Sr Sra Доктор Господин Госпожа Κυρία Κύριος".split()
CUES = ("name is", "Name:", "Contact:", "Signed:", "Author:")
#: Fixed list: particles between parts of a name.
PARTICLES = ("al", "bin", "da", "de la", "de", "del", "di", "du", "el", "la", "le", "van der", "van", "von")
#: A capitalised word of at most four parts of at most 40 letters.
CAP = r"\p{Lu}(?:[\p{L}\p{M}]{1,39}+|(?=['’-]\p{Lu}))(?:['’-]\p{Lu}[\p{L}\p{M}]{1,39}+){0,3}+(?![\p{L}\p{M}\p{N}]|['’-]\p{Lu})"
#: Kind and pattern of all but names, the first that fits at a place wins. No pattern goes back over a long text: what
#: repeats is a class of characters, is bounded, or gives nothing back.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?=[A-Za-z0-9.-]{3,255}+(?![A-Za-z0-9.-]))[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{6,39}+(?![\w:]|\.\d))(?=(?:[0-9A-Fa-f]*+:){2})(?=[0-9A-Fa-f:]{0,37}::|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f])(?=[A-Fa-f:]{0,38}\d)[0-9A-Fa-f:]{6,39}+",
    "ip": r"(?=\d)(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})(?!\w)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?=\d)(?<![\w.+])\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?=[+(\d])(?<![\w.])(?:\+\d{8,15}|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4})(?!\w|[.-]\d)",
}
NAMES = ("given", "surname")
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: The same and every capitalised word, for texts that hold a full name.
WITH_WORDS = rf"{PATTERN}|(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}'’-]){CAP}"
#: Fixed list: endings of surnames that tell a gender or an origin, and stay.
ENDINGS = "(?:skaya|sky|ski|ska|ova|eva|ina|ov|ev|in|sen|ская|ский|ова|ева|ина|ов|ев|ин)$"


def _based(letters: str, low: int, high: int) -> str:
    """The small letters between two code points that are one of ``letters`` under marks."""
    return "".join(chr(c) for c in range(low, high) if unicodedata.category(chr(c)) == "Ll" and unicodedata.normalize("NFD", chr(c))[0] in letters)


#: Letters by class, and what a surrogate draws from: accented letters go by their base letter, letters by their script.
CLASSES = {
    "[0-9]": "0123456789",
    f"[aeiou{_based('aeiou', 0xC0, 0x250)}{_based('aeiou', 0x1E00, 0x1F00)}æœøıə]": "aeiou",
    r"\p{IsLatin}": "bcdfghjklmnpqrstvwxz",
    "[аеиоуыэюяёіїєў]": "аеиоуя",
    r"\p{IsCyrillic}": "бвгджзклмнпрстфхцч",
    f"[αεηιουω{_based('αεηιουω', 0x370, 0x400)}{_based('αεηιουω', 0x1F00, 0x2000)}]": "αεηιοω",
    r"\p{IsGreek}": "βγδζθκλμνξπρστφχψ",
    r"\p{IsArmenian}": "".join(map(chr, range(0x561, 0x586))),
    r"\p{L}": "bcdfghjklmnpqrstvwxz",
}
DIGEST_BYTES = 64
#: Draws after which a surrogate grows by letters or digits, one for each further draw.
GROW = 6
ROUNDS = 40


def _any_of(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [c + _any_of(rest) for c, rest in sorted(heads.items())]
    return (parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})" + "?" * ("" in words)) if parts else ""


def full_names(given: dict[str, list[str]]) -> str:
    """The pattern of full forms."""
    names = sorted({x for group in given.values() for n in group for x in (n, n.upper())})
    one, title = _any_of(names), rf"{_any_of(sorted({*TITLES, *(t.upper() for t in TITLES)}))}\.?\x20"
    before = rf"(?:\p{{Lu}}\.\x20?)?(?:(?:{'|'.join(PARTICLES)})\x20)?"
    by_name = rf"(?:{title})?{one}(?:\x20{one})?\x20{before}{CAP}(?:\x20(?:y\x20)?{CAP})?"
    by_cue = rf"(?<=(?:{'|'.join(CUES)})\x20){CAP}(?:\x20{CAP}){{0,2}}"
    return rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{by_name}|{title}{before}{CAP}|{by_cue})"


def names_of(text: Column, given: dict[str, list[str]]) -> Column:
    """The words, in small letters, of all full forms in a text, without titles."""
    words = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(full_names(given)), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit(CAP), F.lit(0))))
    titles = F.array(*(F.lit(t.lower()) for t in TITLES))
    return F.array_except(F.array_distinct(F.transform(words, F.lower)), titles)


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all spellings of an entity."""
    bare = F.regexp_replace(mention, "[^0-9+]", "")
    return F.when(kind.isin("ssn", "phone", "card"), bare).when(kind == "email", ascii_lower(mention)).when(kind == "ip", mention).when(kind == "iban", F.lower(F.replace(mention, F.lit(" ")))).otherwise(F.lower(mention))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i % DIGEST_BYTES) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _pick(letters: str, b: Column) -> Column:
    return F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))


def _draw(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate, in canonical form, that the given attempt draws."""
    stem = F.when(kind == "surname", F.regexp_replace(entity, f"(?<=\\p{{L}}{{2}}){ENDINGS}", "")).otherwise(entity)  # so that a family's forms stay one
    seed = F.concat_ws("|", F.lit(key), kind, stem, attempt.cast("string"))
    digest = F.concat(F.sha2(F.concat(seed, F.lit("|a")), 256), F.sha2(F.concat(seed, F.lit("|b")), 256))

    def letter(c: Column, i: Column) -> Column:
        b, out = _byte(digest, i), c
        for found, letters in reversed(CLASSES.items()):
            out = F.when(c.rlike(found), _pick(letters, b)).otherwise(out)
        return F.when((kind == "ip6") & c.rlike("[0-9a-f]"), _pick("0123456789abcdef", b)).otherwise(out)

    chars = _chars(stem)
    tail = F.char_length(F.regexp_extract(entity, r"(\.[a-z0-9-]+)?$", 1))  # an email's top level stays
    # a phone's or account's country stays, and what makes an address a private one
    head = F.when(kind == "phone", F.char_length(F.regexp_extract(entity, r"^(\+(?:1|7|2[07]|[3-689]\d|2\d\d)|\+)?", 1)))
    head = head.when(kind == "ip6", F.char_length(F.regexp_extract(entity, r"^(fe80|f[cd])?", 1))).when(kind == "iban", 4).otherwise(0)
    fixed = lambda i: ((kind == "email") & (i >= F.char_length(stem) - tail)) | (i < head)
    drawn = F.array_join(F.transform(chars, lambda c, i: F.when(fixed(i), c).otherwise(letter(c, i))), "")
    last = F.element_at(chars, F.when(kind == "email", 1).otherwise(-1))
    grows = F.when(attempt > GROW, F.sequence(F.lit(1), attempt - GROW)).otherwise(F.array().cast("array<int>"))
    more = F.array_join(F.transform(grows, lambda i: letter(last, i + 40)), "")
    ending = F.substring(entity, F.char_length(stem) + 1, F.char_length(entity))
    grown = F.when(kind == "email", F.concat(more, drawn)).when(kind == "ip6", drawn).otherwise(F.concat(drawn, more, ending))
    return F.when(kind == "ip", _draw_ip(entity, attempt, digest)).when((kind == "card") & (_luhn(chars) == 0), _with_check(_chars(grown))).when(kind == "iban", _with_mod97(grown)).otherwise(grown)


def _draw_ip(ip: Column, attempt: Column, digest: Column) -> Column:
    """Private addresses stay in their network, later draws in 10.0.0.0/8 and 240.0.0.0/4, where there is more room."""
    byte = [_byte(digest, F.lit(i)) for i in range(4)]
    public = F.when((byte[0] % 223 + 1).isin(10, 127, 172, 192), 198).otherwise(byte[0] % 223 + 1)
    private = ip.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
    first = F.when(private & (attempt > 2 * GROW), byte[0] % 15 + 240).when(private & (attempt > GROW), 10).when(private, F.substring_index(ip, ".", 1).cast("int")).otherwise(public)
    second = F.when(private & ip.startswith("192.168.") & (first == 192), 168).when(private & (first == 172), byte[1] % 16 + 16).otherwise(byte[1])
    return F.concat_ws(".", first, second, byte[2], byte[3])


def _luhn(digits: Column) -> Column:
    """Checksum of an array of digits, 0 for a valid card number."""
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.reverse(digits), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, d: s + d) % 10


def _with_check(digits: Column) -> Column:
    body = F.slice(digits, F.lit(1), F.size(digits) - 1)
    return F.concat(F.array_join(body, ""), ((10 - _luhn(F.concat(body, F.array(F.lit("0"))))) % 10).cast("string"))


def _mod97(text: Column) -> Column:
    """Digits and small letters, a as 10, as a number modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 87)
    return F.aggregate(_chars(text), F.lit(0), lambda n, c: (n * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def valid_iban(text: Column) -> Column:
    return _mod97(F.concat(F.substring(text, F.lit(5), F.char_length(text)), F.substring(text, 1, 4))) == 1


def _with_mod97(text: Column) -> Column:
    body, country = F.substring(text, F.lit(5), F.char_length(text)), F.substring(text, 1, 2)
    return F.concat(country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)


def _given(key: str, given: dict[str, list[str]]) -> Column:
    """Each list of given names in keyed order, each name mapped to the next: no two to one, none to itself."""
    pairs = {}
    for group in given.values():
        order = sorted(group, key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
        for a, b in zip(order, order[1:] + order[:1]):
            pairs.setdefault(a.lower(), b.lower())
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def mentions(docs: DataFrame, given: dict[str, list[str]] = GIVEN) -> DataFrame:
    """``(doc_id, text_hash, named, pos, kind, mention, entity)`` for each match in each text, numbered; ``named`` says
    that the text holds names, so that its capitalised words are matches too. Those that aren't its names, and numbers
    that only look like accounts, have no kind."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text", names_of(F.col("text"), given).alias("names"))
    rows = rows.withColumn("named", F.size("names") > 0)
    found = rows.select("doc_id", "text_hash", "named", "names", F.posexplode(_matches(F.col("text"), F.col("named"))).alias("pos", "mention"))
    kind = F.when(F.col("named") & F.array_contains("names", F.lower("mention")), F.when(F.lower("mention").isin([n.lower() for group in given.values() for n in group]), "given").otherwise("surname"))
    for name in reversed(KINDS):
        kind = F.when(F.col("mention").rlike(f"^(?:{KINDS[name]})$"), name).otherwise(kind)
    found = found.withColumn("kind", kind).withColumn("entity", canonical(F.col("kind"), F.col("mention")))
    real = (F.col("kind") != "iban") | valid_iban(F.col("entity"))
    return found.select("doc_id", "text_hash", "named", "pos", F.when(real, F.col("kind")).alias("kind"), "mention", "entity")


def _matches(text: Column, named: Column) -> Column:
    return F.when(named, F.regexp_extract_all(text, F.lit(WITH_WORDS), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def surrogates(entities: DataFrame, key: str, given: dict[str, list[str]] = GIVEN) -> DataFrame:
    """``(kind, entity, surrogate)`` for the distinct ``entities(kind, entity)``: surrogates differ from each other
    and from every entity of their kind, and none holds its entity. Those that don't are drawn again, the earlier draw
    and smaller entity keeping its own; after some draws they grow longer, so the rounds end."""
    now = settle(entities.where("kind != 'given'").withColumn("attempt", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "entity"))
    for _ in range(ROUNDS):
        drawn = settle(now.select("kind", "entity", "attempt", _draw(F.col("kind"), F.col("entity"), F.col("attempt"), key).alias("surrogate")))
        real = drawn.select("kind", F.col("entity").alias("surrogate"))
        taken = drawn.join(real, ["kind", "surrogate"], "left_semi").select("kind", "entity")
        twice = drawn.withColumn("r", rank).where("r > 1").select("kind", "entity")
        told = drawn.where(F.contains("surrogate", "entity")).select("kind", "entity")
        bad = settle(taken.union(twice).union(told).distinct().withColumn("bad", F.lit(1)))
        if bad.isEmpty():
            own = F.coalesce(_given(key, given)[F.col("entity")], F.col("entity"))
            return drawn.select("kind", "entity", "surrogate").union(entities.where("kind = 'given'").select("kind", "entity", own))
        now = settle(drawn.join(bad, ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("bad", F.lit(0))).alias("attempt")))
    raise RuntimeError("surrogates still collide")


def _render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's spelling: its punctuation and case."""
    plain = F.regexp_replace(surrogate, r"[^\p{L}\p{M}\p{N}]", "")
    before = lambda i: F.char_length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"[^\p{L}\p{M}\p{N}]", ""))
    cased = lambda c, x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)
    laid = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.rlike(r"[\p{L}\p{M}\p{N}]"), cased(c, F.substring(plain, before(i), F.lit(1)))).otherwise(c)), "")
    n = F.char_length(F.regexp_replace(mention, r"[^\p{L}\p{M}\p{N}]", ""))
    laid = F.concat(laid, F.substring(plain, n + 1, F.char_length(plain)))
    capital = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    email = F.when(F.char_length(mention) == F.char_length(surrogate), laid).otherwise(surrogate)
    return F.when(kind == "given", capital).when((kind == "surname") & (mention == F.upper(mention)), F.upper(laid)).when(kind.isin("ip", "ip6"), surrogate).when(kind == "email", email).otherwise(laid)


def replace_pii(docs: DataFrame, key: str, given: dict[str, list[str]] = GIVEN) -> DataFrame:
    """``(row struct, text, entities)`` for each row of ``docs(doc_id, text, ...)``: the row, its text with surrogates,
    and how many mentions of each kind were replaced.

    ``key`` is secret and decides all surrogates; ``given`` are the given names by group. A null text stays null, an
    empty one empty. Repeated rows, also under one doc_id or none, are each rewritten, alike where alike. Columns of
    any name come back in ``row``. An empty table gives an empty one. Whole texts are read whatever their length; an
    address of over 64 characters before the @ or 255 after it, and a word of over 40 letters or four hyphened parts, are no entities. Of two
    kinds that fit at a place the first of ``KINDS`` wins.
    """
    found = settle(mentions(docs, given))
    chosen = settle(surrogates(found.where("kind is not null").select("kind", "entity").distinct(), key, given))
    drawn = found.join(spread(chosen), ["kind", "entity"], "left").select("doc_id", "text_hash", "named", "pos", "kind", F.coalesce(_render(F.col("kind"), F.col("mention"), F.col("surrogate")), F.col("mention")).alias("new"))
    news = drawn.groupBy("doc_id", "text_hash", "named").agg(F.sort_array(F.collect_set(F.struct("pos", "kind", "new"))).alias("news"))
    count = lambda k: F.size(F.filter("news", lambda x: x["kind"] == k)).cast("bigint").alias(k)
    kinds = (*KINDS, *NAMES)
    # an array of plain strings: a field of the n-th struct would be read by making the array of all its fields
    per_doc = news.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "named", F.transform("news", lambda x: x["new"]).alias("new"), F.struct(*map(count, kinds)).alias("counts"))
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))
    joined = rows.join(per_doc, F.col("row_id").eqNullSafe(F.col("found_id")) & (F.col("row_hash") == F.col("found_hash")), "left")
    gaps = F.when(F.col("named"), F.split("row.text", WITH_WORDS)).otherwise(F.split("row.text", PATTERN))
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("new", i), F.lit("")))), "")
    none = F.struct(*(F.lit(0).cast("bigint").alias(k) for k in kinds))
    return joined.select("row", F.when(F.col("new").isNull(), F.col("row.text")).otherwise(text).alias("text"), F.coalesce("counts", none).alias("entities"))
