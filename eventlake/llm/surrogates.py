"""Surrogates for personal data, on DataFrame functions alone.

Mentions are found by one pattern. Each entity (type and canonical form) has a keyed surrogate of
its own kind: digits for digits, letters of the same case for letters, the separators of the
mention, the check digit of a card valid or not as before, an address of the same visibility, a
name of the same gender and script. A name is found behind a form of address; in the same text its
parts are then found without one too, and get the same surrogates. The surrogate depends on key and entity alone, so all
mentions of an entity agree in every document and texts need not be shuffled. What does go
through a shuffle is the set of distinct entities: two of them with one surrogate, or a surrogate
that is itself an entity of the corpus, are given another attempt until none is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.quality import let
from eventlake.llm.scratch import release, written

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Forms of address with the gender they tell; "n" tells none.
ADDRESS = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Don", "Signor", "господин", "Господин", "г-н", "κύριος", "Κύριος", "κύριο", "Κύριο"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Doña", "Signora", "госпожа", "Госпожа", "г-жа", "κυρία", "Κυρία"),
    "n": ("Mx", "Dr", "Prof", "Professor", "Professorin", "Doctor", "Doktor", "доктор", "Доктор", "профессор", "Профессор", "δρ", "Δρ"),
}
_TITLES = "|".join(sorted((t for g in ADDRESS.values() for t in g), key=lambda t: (-len(t), t)))
_NAME = "\\p{Lu}\\p{L}+(?:['’-]\\p{Lu}\\p{L}+)*"
_HEX4 = "[0-9A-Fa-f]{1,4}"

#: Type -> pattern of a mention, in order of precedence.
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]++@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)*\\.\\p{L}{2,24}(?![\\p{L}\\p{N}])",
    "mac": "(?<![\\p{L}\\p{N}:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\\1){4}[0-9A-Fa-f]{2}(?![\\p{L}\\p{N}]|[:-][0-9A-Fa-f])",
    "ipv6": f"(?<![\\p{{L}}\\p{{N}}:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=(?:{_HEX4}:){{2}})(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})(?![\\p{{L}}\\p{{N}}]|:[0-9A-Fa-f:])",
    "ip": f"(?<![\\p{{L}}\\p{{N}}.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![\\p{{L}}\\p{{N}}]|\\.[0-9])",
    "iban": "(?<![\\p{L}\\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}\\p{N}])",
    "secret": "(?<![\\p{L}\\p{N}])(?:(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[A-F]*[0-9])[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|rk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,200})(?![\\p{L}\\p{N}])",
    "card": "(?<![\\p{L}\\p{N}+.,-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\2[0-9]{4}\\2[0-9]{1,7})(?![\\p{L}\\p{N}]|[.,-][0-9])",
    "ssn": "(?<![\\p{L}\\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\\p{L}\\p{N}]|-[0-9])",
    "phone": "(?<![\\p{L}\\p{N}+])(?:\\+[0-9]{1,3}(?:[ .-]?\\([0-9]{1,4}\\))?(?:[ .-]?[0-9]{2,5}){2,5}|\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\\3[0-9]{4})(?![\\p{L}\\p{N}]|-[0-9])",
    "name": f"(?<![\\p{{L}}\\p{{N}}-])(?:(?:{_TITLES})\\.? ){{1,3}}{_NAME}(?: {_NAME}){{0,2}}",
}
#: No mention begins inside a word, which rules out most places at once.
_WORD_START = "(?<![\\p{L}\\p{N}])"
PATTERN = f"{_WORD_START}(?:{'|'.join(PATTERNS.values())})"

#: Syllables and endings of made-up names, by script, part and gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве во га ге да де до за зе ка ке ко ла ле ло ма ме мо на не но ра ре ро са се та те".split(),
    "greek": "βα βε βο γα γε γο δα δε δο ζα ζε κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
    "armenian": "բա բե բո գա գե գո դա դե դո զա զե կա կե կո լա լե լո մա մե մո նա նե նո ռա ռե սա սե սո տա տե տո վա".split(),
}
ENDINGS = {
    ("latin", "given_m"): "n s rt ld".split(), ("latin", "given_f"): "na lia rina ssa".split(), ("latin", "given_n"): "l m x r".split(), ("latin", "family"): "nd rsen tt lin".split(),
    ("cyrillic", "given_m"): "н р с й".split(), ("cyrillic", "given_f"): "на ля рия сья".split(), ("cyrillic", "given_n"): "л м к т".split(), ("cyrillic", "family"): "нко рин лев дзе".split(),
    ("greek", "given_m"): "νος ρης λας σιος".split(), ("greek", "given_f"): "νη ρία λία σσα".split(), ("greek", "given_n"): "λι μι νι ρι".split(), ("greek", "family"): "κης δης πουλος τος".split(),
    ("armenian", "given_m"): "ն ր ս կ".split(), ("armenian", "given_f"): "նա լիա րինե սա".split(), ("armenian", "given_n"): "լ մ թ ք".split(), ("armenian", "family"): "նյան րյան լյան սյան".split(),
}
NAMES = ("given_m", "given_f", "given_n", "family")


def _type(mention: Column) -> Column:
    whole = lambda kind: F.rlike(mention, F.lit(_alone(kind)))
    out = F.when(F.contains(mention, F.lit("@")), F.lit("email"))
    for kind in ("mac", "ipv6", "ip", "iban", "secret"):
        out = out.when(whole(kind), F.lit(kind))
    bare = F.regexp_replace(mention, "[^0-9]", "")
    out = out.when(F.rlike(mention, F.lit("^\\p{L}")), F.lit("name")).when(whole("ssn"), F.lit("ssn"))
    return out.when(F.rlike(mention, F.lit("^[0-9 -]+$")) & (F.length(bare) >= 13), F.lit("card")).otherwise(F.lit("phone"))


def _alone(kind: str) -> str:
    """The pattern of a whole mention of one type; in PATTERN the groups are numbered through."""
    return "^(?:" + PATTERNS[kind].replace("\\2", "\\1").replace("\\3", "\\1") + ")$"


def _marks(mention: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(mention, "[^\\p{L}\\p{N}]", ""))


def _titles(parts: Column) -> Column:
    """How many of the leading parts of a mention are forms of address; the last part never is."""
    is_title = F.lit(f"^(?:{_TITLES})\\.?$")
    first = F.array_position(F.transform(parts, lambda p, i: F.rlike(p, is_title) & (i < F.size(parts) - 1)), F.lit(False)).cast("int")
    return first - 1


def _gender(titles: Column) -> Column:
    has = lambda g: F.exists(titles, lambda t: F.rlike(t, F.lit(f"^(?:{'|'.join(ADDRESS[g])})\\.?$")))
    return F.when(has("f"), F.lit("given_f")).when(has("m"), F.lit("given_m")).otherwise(F.lit("given_n"))


def entities(mention: Column) -> Column:
    """The (type, canonical) structs of a mention: one, or for a name behind a form of address one of each of its parts."""

    def of(kind: Column) -> Column:
        def name(parts: Column, k: Column) -> Column:
            last = F.size(parts) - k - 1
            return let(_gender(F.slice(parts, F.lit(1), k)), lambda g: F.transform(F.slice(parts, k + 1, last + 1), lambda p, i: F.struct(F.when(i == last, F.lit("family")).otherwise(g).alias("type"), F.lower(p).alias("canonical"))))

        canonical = F.when(kind.isin("email", "ip", "ipv6"), F.lower(mention)).otherwise(_marks(mention))
        return F.when(kind == "name", let(F.split(mention, " ", -1), lambda parts: let(_titles(parts), lambda k: name(parts, k)))).otherwise(F.array(F.struct(kind.alias("type"), canonical.alias("canonical"))))

    return let(_type(mention), of)


def _byte(digest: Column, i) -> Column:
    """The i-th number below 65536 of a 512-bit digest in hex, from 0; 32 of them, then anew."""
    return F.conv(F.substr(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _digest(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string")).cast("binary"), 512)


def _luhn_sum(digits: Column) -> Column:
    """The sum of the checksum used by payment cards, modulo 10."""

    def one(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * 2
        return F.when((F.length(digits) - i) % 2 == 0, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(digits, "", -1), one), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _shape(canonical: Column, digest: Column) -> Column:
    """Each digit becomes a digit and each letter a letter, by position; other characters stay."""
    wide = F.concat(digest, F.sha2(digest, 512), F.sha2(F.concat(digest, F.lit("+")), 512), F.sha2(F.concat(digest, F.lit("*")), 512))

    def of(w: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            number = F.conv(F.substr(w, (i % 128) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 128).cast("int") * 7
            letters = F.when(F.rlike(c, F.lit("\\p{IsCyrillic}")), F.substr(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), number % 27 + 1, F.lit(1))).otherwise(F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), number % 26 + 1, F.lit(1)))
            return F.when(F.rlike(c, F.lit("[0-9]")), (number % 10).cast("string")).when(F.rlike(c, F.lit("\\p{L}")), letters).otherwise(c)

        return F.array_join(F.transform(F.split(canonical, ""), one), "")

    return let(wide, of)


def _hex(canonical: Column, digest: Column) -> Column:
    """As many hexadecimal digits."""
    wide = F.concat(digest, F.sha2(digest, 512))
    return F.substr(wide, F.lit(1), F.length(canonical))


def _card(canonical: Column, digest: Column) -> Column:
    """First digit kept, the rest drawn; the last one makes the checksum hold if it held before."""
    drawn = _shape(canonical, digest)
    head = F.concat(F.substr(canonical, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), F.length(canonical) - 2))

    def of(h: Column) -> Column:
        check = (10 - _luhn_sum(F.concat(h, F.lit("0")))) % 10
        wrong = (check + 1 + _byte(digest, F.lit(31)) % 9) % 10
        return F.concat(h, F.when(_luhn_sum(canonical) == 0, check).otherwise(wrong).cast("string"))

    return let(head, of)


#: Attempts after which an address of a small private network moves to the largest one.
NARROW_ATTEMPTS = 3


def _ip(canonical: Column, digest: Column, attempt: Column) -> Column:
    """Private and loopback networks keep their leading numbers; others stay public.

    Where a private network has no free address left, the surrogate is one of 10.0.0.0/8.
    """
    octet = lambda i: (_byte(digest, F.lit(i)) % 254 + 1).cast("string")
    first = _byte(digest, F.lit(0)) % 114 + 11  # 11..124
    own = F.regexp_extract(canonical, "^(10\\.|127\\.|192\\.168\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.)", 1)

    def of(private: Column) -> Column:
        rest = F.when(private == "", F.lit(3)).otherwise(4 - F.size(F.split(private, "\\.", -1)) + 1)
        tail = F.array_join(F.slice(F.array(octet(1), octet(2), octet(3)), F.lit(1), rest), ".")
        return F.concat(F.when(private == "", F.concat(first.cast("string"), F.lit("."))).otherwise(private), tail)

    return let(F.when(F.rlike(own, F.lit("^1[79]2")) & (attempt >= NARROW_ATTEMPTS), F.lit("10.")).otherwise(own), of)


def _drawn_hex(canonical: Column, digest: Column) -> Column:
    """A hexadecimal digit for each letter or digit, by position; other characters stay."""
    return F.array_join(F.transform(F.split(canonical, ""), lambda c, i: F.when(F.rlike(c, F.lit("[0-9a-f]")), F.substr(digest, i % 128 + 1, F.lit(1))).otherwise(c)), "")


def _ipv6(canonical: Column, digest: Column) -> Column:
    """The first group, which tells the kind of address, is kept."""
    head = F.regexp_extract(canonical, "^[^:]*", 0)
    return F.concat(head, F.substr(_drawn_hex(canonical, digest), F.length(head) + 1, F.length(canonical)))


def _mac(canonical: Column, digest: Column) -> Column:
    """The first two digits, which tell local from universal addresses, are kept."""
    return F.concat(F.substr(canonical, F.lit(1), F.lit(2)), F.substr(_drawn_hex(canonical, digest), F.lit(3), F.lit(10)))


def _email(canonical: Column, digest: Column) -> Column:
    """Same shape; the part behind the last dot is kept."""
    tail = F.regexp_extract(canonical, "\\.[^.]*$", 0)
    return F.concat(_shape(F.substr(canonical, F.lit(1), F.length(canonical) - F.length(tail)), digest), tail)


def _iban(canonical: Column, digest: Column) -> Column:
    """Country kept; the two check digits hold (ISO 7064, modulo 97)."""
    country, rest = F.substr(canonical, F.lit(1), F.lit(2)), F.substr(_shape(canonical, digest), F.lit(5), F.length(canonical))

    def value(acc: Column, c: Column) -> Column:
        digit = F.rlike(c, F.lit("[0-9]"))
        return F.when(digit, (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 87) % 97)

    def of(r: Column) -> Column:
        left = F.aggregate(F.split(F.concat(r, country, F.lit("00")), ""), F.lit(0), lambda a, c: F.coalesce(value(a, c), a))
        return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), r)

    return let(rest, of)


def _phone(canonical: Column, digest: Column) -> Column:
    """The first digit, which opens a country code or an area, is kept."""
    return F.concat(F.substr(canonical, F.lit(1), F.lit(1)), F.substr(_shape(canonical, digest), F.lit(2), F.length(canonical)))


def _name(kind: Column, canonical: Column, digest: Column, attempt: Column) -> Column:
    of = lambda table, script: reduce(lambda w, x: w.when(script == x, F.lit(" ".join(table[x]))), list(table)[1:], F.when(script == list(table)[0], F.lit(" ".join(table[list(table)[0]]))))
    script = reduce(lambda w, x: w.when(F.rlike(canonical, F.lit(f"^\\p{{Is{x.title()}}}")), F.lit(x)), list(SYLLABLES)[1:], F.when(F.lit(False), F.lit("")))
    endings = {f"{a} {b}": e for (a, b), e in ENDINGS.items()}

    def made(syllables: Column, ends: Column) -> Column:
        stem = F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), lambda i: F.get(syllables, _byte(digest, i) % F.size(syllables)))
        return F.concat(F.array_join(stem, ""), F.get(ends, _byte(digest, F.lit(0)) % F.size(ends)))

    def written_in(script: Column) -> Column:
        return let(F.split(of(SYLLABLES, script), " "), lambda x: let(F.split(of(endings, F.concat(script, F.lit(" "), kind)), " "), lambda e: made(x, e)))

    return let(F.coalesce(script, F.lit("latin")), written_in)


def surrogate(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate of one entity."""

    def of(digest: Column) -> Column:
        hexadecimal = F.rlike(canonical, F.lit("^[0-9a-f]+$"))
        prefix = F.regexp_extract(canonical, "^(akia|sk|pk|rk|ghp|gho|xoxb|xoxp)", 1)
        return (
            F.when(kind == "email", _email(canonical, digest))
            .when(kind == "ip", _ip(canonical, digest, attempt))
            .when(kind == "ipv6", _ipv6(canonical, digest))
            .when(kind == "mac", _mac(canonical, digest))
            .when(kind == "iban", _iban(canonical, digest))
            .when((kind == "secret") & hexadecimal, _hex(canonical, digest))
            .when(kind == "secret", F.concat(prefix, F.substr(_shape(canonical, digest), F.length(prefix) + 1, F.length(canonical))))
            .when(kind == "card", _card(canonical, digest))
            .when(kind == "ssn", _shape(canonical, digest))
            .when(kind == "phone", _phone(canonical, digest))
            .otherwise(_name(kind, canonical, digest, attempt))
        )

    return let(_digest(key, kind, canonical, attempt), of)


def _refit(mention: Column, form: Column) -> Column:
    """``form`` in the separators and upper case of ``mention``."""
    marks = F.split(F.regexp_replace(form, "[^\\p{L}\\p{N}]", ""), "")
    shout = (mention == F.upper(mention)) & (mention != F.lower(mention))

    def of(m: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            mark = F.rlike(c, F.lit("[\\p{L}\\p{N}]"))
            put = F.get(m, acc["at"])
            put = F.when(F.rlike(c, F.lit("\\p{Lu}")) | shout, F.upper(put)).otherwise(put)
            return F.struct((acc["at"] + mark.cast("int")).alias("at"), F.concat(acc["out"], F.when(mark, F.coalesce(put, F.lit(""))).otherwise(c)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(F.split(mention, ""), start, step)["out"]

    return let(marks, of)


def _replacement(key: str, mention: Column, found: Column, attempt_of) -> Column:
    """What stands for ``mention``, whose entities are ``found``."""
    kind = F.get(found, F.lit(0))["type"]

    def named(forms: Column, parts: Column) -> Column:
        k = F.size(parts) - F.size(forms)
        cased = lambda f, p: F.when(p == F.upper(p), F.upper(f)).otherwise(F.concat(F.upper(F.substr(f, F.lit(1), F.lit(1))), F.substr(f, F.lit(2), F.length(f))))
        return F.array_join(F.concat(F.slice(parts, F.lit(1), k), F.transform(forms, lambda f, i: cased(f, F.get(parts, i + k)))), " ")

    def of(forms: Column) -> Column:
        first = F.get(forms, F.lit(0))
        return F.when(kind.isin(*NAMES), let(F.split(mention, " ", -1), lambda parts: named(forms, parts))).when(kind.isin("ip", "ipv6"), first).otherwise(_refit(mention, first))

    return let(F.transform(found, lambda e: surrogate(key, e["type"], e["canonical"], attempt_of(e))), of)


#: What every mention contains; cheap to look for, and few texts have it.
_GUARD = "[0-9@]|[0-9A-Fa-f]:[0-9A-Fa-f]|[{}](?:{})\\.? \\p{{Lu}}".format("".join(sorted({t[0] for t in _TITLES.split("|")})), "|".join(sorted({t[1:] for t in _TITLES.split("|")})))


def mentions(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(_GUARD)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def collisions(found: DataFrame, key: str, rounds: int = 200, strict: int = 20) -> DataFrame:
    """(type, canonical, attempt) of the entities whose first attempt is not theirs alone.

    ``found`` has distinct (type, canonical). For ``strict`` rounds no surrogate may be an entity of
    the corpus either; where a kind's forms are so few that this cannot be had, surrogates still
    differ from one another after it. Raises if ``rounds`` attempts leave two entities with one
    surrogate, which takes more entities of a form than the form has values.
    """
    table = written(found.select("type", "canonical", F.lit(0).alias("attempt")))
    originals = table.select("type", F.col("canonical").alias("form"))
    for k in range(rounds):
        formed = written(table.withColumn("form", surrogate(key, F.col("type"), F.col("canonical"), F.col("attempt"))))
        shared = formed.groupBy("type", "form").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        real = formed.select("type", "form").join(originals, ["type", "form"], "left_semi").distinct().withColumn("real", F.lit(True))
        if k >= strict:
            real = real.limit(0)
        if shared.isEmpty() and real.isEmpty():
            break
        marked = formed.join(shared, ["type", "form"], "left").join(real, ["type", "form"], "left")
        again = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("first.canonical") != F.col("canonical"), F.lit(False))
        table = written(marked.select("type", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt")))
        release(found.sparkSession, times=1)
    else:
        raise ValueError(f"surrogates still collide after {rounds} attempts: more entities than their form has values")
    return table.filter("attempt > 0")


def _free(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its ``text_col`` rewritten; adds ``pii_types``, the types of its mentions in order.

    A null text stays null, without mentions; a text without mentions stays as it is. Of two
    patterns that match at one place the first of ``PATTERNS`` counts. Other columns pass unread
    under any name, except that one named ``pii_types`` is replaced; repeated rows are rewritten
    alike; an empty table stays empty.
    """
    columns = [c for c in docs.columns if c != "pii_types"]
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    text, passed = named(text_col), [named(c) for c in columns]
    new, digest, later = (_free(columns, x) for x in ("new", "digest", "later"))
    found = docs.select(F.explode(mentions(text)).alias("m")).distinct().select(F.explode(entities(F.col("m"))).alias("e")).select("e.*").distinct()
    again = collisions(found, key)
    if again.isEmpty():
        rewritten = docs.select(*passed, _rewrite(key, text, lambda e: F.lit(0)).alias(new))
    else:
        # Texts that mention an entity with a later attempt learn it by the digest of the text.
        tagged = docs.select(*passed, F.sha2(text.cast("binary"), 256).alias(digest))
        of_text = tagged.select(digest, F.explode(mentions(text)).alias("m")).distinct().select(digest, F.explode(entities(F.col("m"))).alias("e")).select(digest, "e.*").distinct()
        attempts = of_text.join(again, ["type", "canonical"]).groupBy(digest).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "type", "canonical"), "attempt"))).alias(later))
        attempt_of = lambda e: F.coalesce(F.try_element_at(F.col(later), F.concat_ws("\x1f", e["type"], e["canonical"])), F.lit(0))
        rewritten = tagged.join(attempts, digest, "left").select(*passed, _rewrite(key, text, attempt_of).alias(new))
    keep = [F.col(f"{new}.text").alias(c) if c == text_col else named(c) for c in columns]
    return rewritten.select(*keep, F.coalesce(f"{new}.types", F.array().cast("array<string>")).alias("pii_types"))


def _rewrite(key: str, text: Column, attempt_of) -> Column:
    """(text, types) of a rewritten text."""

    def put(found: Column, names: Column, pattern: Column) -> Column:
        # a mention without a form of address is a part of a name that has one in this text
        def of(m: Column) -> Column:
            return let(F.filter(names, lambda n: n["canonical"] == F.lower(m)), lambda own: F.when(F.size(own) > 0, F.slice(own, F.lit(1), F.lit(1))).otherwise(entities(m)))

        each = F.transform(found, lambda m: let(of(m), lambda e: F.struct(_replacement(key, m, e, attempt_of).alias("new"), F.get(e, F.lit(0))["type"].alias("type"))))

        def joined(new: Column) -> Column:
            gaps = F.transform(F.split(text, pattern, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(new, i)["new"], F.lit(""))))
            types = F.transform(new, lambda x: F.when(x["type"].isin(*NAMES), F.lit("name")).otherwise(x["type"]))
            return F.struct(F.when(F.size(new) > 0, F.array_join(gaps, "")).otherwise(text).alias("text"), types.alias("types"))

        return let(each, joined)

    def widened(found: Column, titled: Column) -> Column:
        """Looks for the parts of the ``titled`` names too."""
        behind = lambda m: let(F.split(m, " ", -1), lambda parts: F.slice(parts, _titles(parts) + 1, F.size(parts)))
        shown = F.flatten(F.transform(titled, behind))
        longest = F.array_sort(F.transform(F.array_distinct(F.concat(shown, F.transform(shown, F.upper))), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
        parts = F.concat(F.lit(f"{PATTERN}|{_WORD_START}(?:"), F.array_join(F.transform(longest, lambda x: x["n"]), "|"), F.lit(")(?![\\p{L}\\p{N}])"))
        pattern = F.when(F.size(titled) > 0, parts).otherwise(F.lit(PATTERN))
        names = F.flatten(F.transform(titled, entities))
        return let(pattern, lambda p: let(F.when(F.size(titled) > 0, F.regexp_extract_all(text, p, F.lit(0))).otherwise(found), lambda every: let(names, lambda n: put(every, n, p))))

    return let(mentions(text), lambda found: let(F.filter(found, lambda m: _type(m) == "name"), lambda titled: widened(found, titled)))
