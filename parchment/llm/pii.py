"""PII: detected entities are replaced by surrogates, in SQL functions only.

Entities are found by one pattern, in one pass over each whole text. A surrogate comes from a keyed hash (HMAC-SHA-256) of kind and
value, shaped like the value: digits stay digits, letters keep their case and script, separators stay, card numbers and IBANs that
check keep checking, names keep the gender that their title tells. Equal entities have equal surrogates everywhere, and a name or a
secret that a text gives once is replaced wherever else the text has it (coreference). Distinct entities of any kinds never
share a surrogate, nor is one ever the value of a real entity: those that would are hashed again with the next attempt number.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

# The patterns of the kinds, in order of precedence. Groups that may repeat without bound are possessive: the matcher then
# goes on in a loop, where it would else call itself for every turn and run out of stack on a long run of labels.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)++"
#: The label of a secret in any case, with blanks around its sign; then a value in quotes up to the closing one, or up to a blank.
LABEL = r"(?i:password|passwd|secret|token|api_key)[ \t]*[=:]"
SECRET = rf"(?<![A-Za-z0-9]){LABEL}[ \t]*" + r"(?:\"[^\"\r\n]{4,}\"|'[^'\r\n]{4,}'|[\"']?[^\s\"',;]{4,})"
ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![0-9.])(?<!\b(?i:v|ver|version|rev|release)[ .:]{{0,2}})(?:{OCTET}\.){{3}}{OCTET}(?![0-9.]*[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-])"
PHONE = (
    r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9+])\+(?=(?:[ .()-]{0,2}[0-9]){7,15}(?![0-9]))[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])"
)
MALE = "Mr|Herr|Monsieur|Señor|Sr|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа"
EITHER = "Dr|Prof|Professor"
NAME = r"(?:\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]++(?:-\p{Lu}[\p{L}\p{M}]++)*+|\p{IsHan}{1,4}|(?!\p{IsHan})\p{Lo}[\p{Lo}\p{M}]*)"
PERSON = rf"(?<![\p{{L}}-])(?:{MALE}|{FEMALE}|{EITHER})\.? {NAME}(?: {NAME})?"
ENTITY = "|".join((EMAIL, SECRET, ACCESS_KEY, IBAN, CARD, IP, SSN, PHONE, PERSON))
#: What every text with an entity has, quick to look for: other texts are spared the whole pattern.
HINT = rf"[0-9@]|{LABEL}|A[KS]IA[A-Z0-9]|(?:{MALE}|{FEMALE}|{EITHER})\.? [\p{{Lu}}\p{{Lo}}]"
#: A name that is one run of cased letters, and the runs that other text is looked through for it.
RUN = r"^\p{Lu}[\p{L}\p{M}]+$"
RUNS = r"\p{L}[\p{L}\p{M}]*|\P{L}+"

# Given names by gender and script, and syllables that family names are made of.
GIVEN = {
    ("m", "latin"): ("Adam", "Boris", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jan", "Karl", "Leo", "Max", "Noel", "Otto", "Paul"),
    ("f", "latin"): ("Ada", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Helga", "Ida", "Julia", "Karla", "Lena", "Mara", "Nina", "Olga", "Paula"),
    ("n", "latin"): ("Alexis", "Chris", "Dominique", "Gabriele", "Kim", "Robin", "Sascha", "Toni"),
    ("n", "cyrillic"): ("Валя", "Женя", "Саша", "Шура"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения"),
}
SYLLABLES = {
    "latin": ("ba", "ben", "dor", "del", "fal", "gar", "hel", "kas", "lin", "mar", "nor", "pel", "ros", "sal", "tan", "vor"),
    "cyrillic": ("ба", "вел", "гор", "дан", "зор", "кас", "лин", "мар", "нор", "пет", "рос", "сал", "тан", "фед", "чер", "шин"),
}

#: A surrogate has the shape of at most so many first characters of its value.
SHAPED = 256

# Letters that stand for letters of a script, upper case, lower case and caseless.
LETTERS = {
    r"[a-z]": "abcdefghijklmnopqrstuvwxyz",
    r"[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"(?=\p{Ll})\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"(?=\p{Lu})\p{IsCyrillic}": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"(?=\p{Ll})\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"(?=\p{Lu})\p{IsGreek}": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{Ll}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{IsHan}": "安白长东方高海和江金林明南平青山石文西小雪阳玉远云",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにの",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニノ",
    r"\p{IsHangul}": "가나다라마바사아자하고노도로모보소오조호",
    r"(?=\p{Lo})\p{IsArabic}": "ابتجحدرزسصطعفقكلمنهوي",
    r"(?=\p{Lo})\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"(?=\p{Lo})\p{IsThai}": "กขคงจฉชซดตถทธนบปพมยรลวสหอ",
    r"(?=\p{Lo})\p{IsDevanagari}": "कखगघचछजझटडतदनपबमयरलवसह",
}


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, in hex."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in secret))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def _at(h: Column, i: int | Column) -> Column:
    """A number from 0 to 255 out of a hex hash."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(h, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(h: Column, i: int, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), _at(h, i) % len(values) + 1)


def _shaped(value: Column, key: Column, hex_only: Column) -> Column:
    """Each digit by a digit, each letter by one of its case and script; the rest stays. ``key`` is hashed anew every 31 characters."""
    chars = F.split(F.substring(value, 1, SHAPED), "")
    place = lambda c, alphabet, x: F.substring(F.lit(alphabet), x % len(alphabet) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        x = _at(F.sha2(F.concat(key, F.lit("#"), F.floor(i / 31).cast("string")).cast("binary"), 256), (i % 31).cast("int"))
        out = F.when(c.rlike("[0-9]"), place(c, "0123456789", x)).when(c.rlike("[a-f]") & hex_only, place(c, "abcdef", x))
        for of, alphabet in LETTERS.items():
            out = out.when(c.rlike(of), place(c, alphabet, x))
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(chars, lambda c: c != ""), one), "")


def _luhn(value: Column) -> Column:
    """The Luhn sum of the digits, modulo ten."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _mod97(iban: Column) -> Column:
    """The remainder that a right IBAN has as 1: country and check digits moved to the end, letters as two digits."""
    plain = F.regexp_replace(iban, " ", "")
    chars = F.filter(F.split(F.concat(F.regexp_replace(plain, "^....", ""), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity at an attempt."""
    h = _hmac(key, F.concat(kind, F.lit("|"), value, F.lit("|"), attempt.cast("string")))
    shaped = lambda v, hex_only=F.lit(False): _shaped(v, h, hex_only)
    script = F.when(value.rlike(r"^[\p{IsCyrillic}'’-]+$"), F.lit("cyrillic")).when(value.rlike(r"\p{IsLatin}"), F.lit("latin")).otherwise(F.lit("other"))
    # a shape has only so many surrogates: every eighth attempt is a character longer, whatever the kind, so that attempts end
    times = F.floor(attempt / 8).cast("int")
    longer = F.concat(F.substring(value, 1, SHAPED), F.repeat(F.substring(value, -1, 1), times))
    digits = F.concat(value, F.repeat(F.lit("0"), times))

    def family(of: str) -> Column:
        s = SYLLABLES[of]
        more = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.element_at(F.array(*(F.lit(v) for v in s)), _at(h, i + 8) % len(s) + 1)), "")
        return F.concat(F.initcap(_pick(h, 0, s)), _pick(h, 1, s), _pick(h, 2, s), more)

    def tail(s: tuple[str, ...]) -> Column:
        syllable = lambda i: F.concat(F.lit("-"), F.initcap(F.element_at(F.array(*(F.lit(v) for v in s)), _at(h, i + 8) % len(s) + 1)))
        return F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), syllable), "")).otherwise(F.lit(""))

    def given(gender: str) -> Column:
        """The lists are short: from the second attempt on a syllable is joined with a hyphen for each attempt."""
        out = shaped(longer)
        for (g, of), names in GIVEN.items():
            if g == gender:
                out = F.when(script == of, F.concat(_pick(h, 3, names), tail(SYLLABLES[of]))).otherwise(out)
        return out

    local, domain = F.regexp_extract(value, "^[^@]*", 0), F.lower(F.regexp_extract(value, "@(.*)$", 1))
    mail = F.concat(shaped(F.concat(local, F.repeat(F.lit("0"), F.floor(attempt / 8).cast("int")))), F.lit("@mx"), F.substring(_hmac(key, F.concat(F.lit("domain|"), domain)), 1, 10), F.lit(".example.net"))
    octets = F.concat(F.concat_ws(".", *((_at(h, i) % 254 + 1).cast("string") for i in range(4))), shaped(F.repeat(F.lit(".0"), times)))
    card = F.concat(F.substring(value, 1, 1), shaped(F.substring(digits, F.lit(2), F.length(digits))))  # the issuer's digit stays
    last = F.regexp_extract(card, "[0-9]$", 0).cast("int")
    fixed = F.concat(F.regexp_replace(card, "[0-9]$", ""), F.pmod(last - _luhn(card), F.lit(10)).cast("string"))
    account = shaped(F.regexp_replace(digits, "^....", ""))
    iban = F.concat(F.substring(value, 1, 2), F.lpad((F.lit(98) - _mod97(F.concat(F.substring(value, 1, 2), F.lit("00"), account))).cast("string"), 2, "0"), account)
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}[ .-]?(?=[(0-9])", 0)
    return (
        F.when(kind == "email", mail)
        .when(kind == "secret", shaped(longer, value.rlike("^[0-9a-f]+$")))
        .when(kind == "access_key", F.concat(F.substring(value, 1, 4), shaped(F.substring(digits, F.lit(5), F.length(digits)))))
        .when(kind == "iban", F.when(_mod97(value) == 1, iban).otherwise(F.concat(F.substring(value, 1, 2), shaped(F.regexp_replace(value, "^..", "")))))
        .when(kind == "ip", octets)
        .when(kind == "card", F.when(_luhn(value) == 0, fixed).otherwise(card))
        .when(kind == "phone", F.concat(country, shaped(F.substring(digits, F.length(country) + 1, F.length(digits)))))
        .when(kind == "given_m", given("m"))
        .when(kind == "given_f", given("f"))
        .when(kind == "given_n", given("n"))
        .when(kind == "family", F.when(script == "cyrillic", family("cyrillic")).when(script == "latin", family("latin")).otherwise(shaped(longer)))
        .otherwise(shaped(digits))
    )


def kind_of(match: Column) -> Column:
    whole = lambda p: match.rlike(f"^(?:{p})$")
    return (
        F.when(match.rlike("^[^=:@]+[=:]") & whole(SECRET), "secret").when(match.contains("@"), "email").when(whole(ACCESS_KEY), "access_key").when(whole(IBAN), "iban")
        .when(whole(CARD), "card").when(whole(IP), "ip").when(whole(SSN), "ssn").when(match.rlike(r"\p{L}"), "person").otherwise("phone")
    )


def _parts(match: Column) -> Column:
    """A match as (kind, value) parts whose values join to it: a person is a title, a given name and a family name, a secret is what its label and quotes leave, another kind itself."""
    part = lambda k, v: F.struct(k.alias("kind") if isinstance(k, Column) else F.lit(k).alias("kind"), v.alias("value"))
    title = F.regexp_extract(match, r"^\S+ ", 0)
    names = F.regexp_replace(match, r"^\S+ ", "")
    given, family = F.regexp_extract(names, "^([^ ]+) ", 1), F.regexp_extract(names, "[^ ]+$", 0)
    gender = F.when(title.rlike(rf"^(?:{MALE})\.? $"), F.lit("given_m")).when(title.rlike(rf"^(?:{EITHER})\.? $"), F.lit("given_n")).otherwise(F.lit("given_f"))
    person = F.when(given == "", F.array(part("text", title), part("family", family))).otherwise(F.array(part("text", title), part(gender, given), part("text", F.lit(" ")), part("family", family)))
    label = r"^[^=:]*[=:][ \t]*[\"']?"
    quoted = F.regexp_replace(match, label, "")
    secret = F.array(part("text", F.regexp_extract(match, label, 0)), part("secret", F.regexp_replace(quoted, "[\"']$", "")), part("text", F.regexp_extract(quoted, "[\"']$", 0)))
    return F.when(kind_of(match) == "person", person).when(kind_of(match) == "secret", secret).otherwise(F.array(part(kind_of(match), match)))


def surrogates(entities: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): no surrogate is that of two entities, and none is a value of any kind."""
    todo, done = ws.table(entities.distinct(), "entities"), None
    real = todo.select(F.col("value").alias("surrogate"))
    for attempt in itertools.count():
        tried = todo.select("kind", "value", surrogate(F.col("kind"), F.col("value"), key, F.lit(attempt)).alias("surrogate"))
        free = tried.join(real, "surrogate", "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate"), "surrogate", "left_anti")
        won = free.groupBy("surrogate").agg(F.min(F.struct(F.xxhash64("kind", "value").alias("h"), "kind", "value")).alias("m")).select(F.col("m.kind").alias("kind"), F.col("m.value").alias("value"), "surrogate")
        won = ws.table(won, "won")
        done = won if done is None else done.unionByName(won)
        todo = ws.table(todo.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "todo")
        if todo.isEmpty():
            return done
    raise AssertionError  # attempts do not end


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with surrogates), n_replaced and kinds of every row of ``docs``.

    ``key`` is the secret that surrogates are made with: the same key gives the same surrogates for the same entities of a table.
    A surrogate has the shape of its value, of its first 256 characters where it is longer; where more values of a shape are to be replaced than
    it has free surrogates, those that are left get longer ones. kinds: the sorted distinct kinds found (access_key, card, email, iban, ip, person, phone, secret, ssn); n_replaced: how many entities
    were. Names and secrets are then also replaced wherever else their text has them: names as whole words, in the case they were given
    in or in capitals, so that an ordinary word in that spelling goes too. Texts without an entity, null and empty ones
    among them, come back as they are, with 0 and no kinds. Repeated rows are treated alike; a null doc_id is carried; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with Workspace(spark) as ws:
        entities = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
        # the one pass of the pattern over whole texts; what follows reads what it found
        rows = ws.result(docs.select("doc_id", "text", entities.alias("found")))
        of_text = ["h1", "h2"]
        found = rows.where(F.size("found") > 0).select(F.xxhash64("text").alias("h1"), F.sha1("text").alias("h2"), "found")
        matches = ws.table(found.dropDuplicates(of_text).select(*of_text, F.posexplode("found").alias("at", "match")).select(*of_text, "at", "match", kind_of(F.col("match")).alias("of"), F.posexplode(_parts(F.col("match"))).alias("k", "part")).select(*of_text, "at", "of", "k", "part.kind", "part.value"), "parts")
        given = surrogates(matches.where("kind != 'text'").select("kind", "value"), key, ws)
        told = ws.table(matches.join(given, ["kind", "value"], "left").withColumn("new", F.coalesce("surrogate", "value")), "told")
        whole = told.groupBy(*of_text, "at", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda x: x["new"]), "").alias("new"))
        lists = whole.groupBy(of_text).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"), F.array_sort(F.collect_set("of")).alias("kinds"))
        # what else of the text stands for them: names by whole words, other values and names wherever they are, longest first
        names = told.where((F.col("of") == "person") & (F.col("kind") != "text"))
        as_runs = names.where(F.col("value").rlike(RUN)).select(*of_text, "kind", F.explode(F.array(F.struct("value", "new"), F.struct(F.upper("value").alias("value"), F.upper("new").alias("new")))).alias("x"))
        as_runs = as_runs.groupBy(*of_text, "x.value").agg(F.min(F.struct("kind", "x.new")).alias("m")).groupBy(of_text).agg(F.map_from_entries(F.collect_list(F.struct("value", "m.new"))).alias("runs"))
        pieces = told.where(F.col("kind") == "secret").unionByName(names.where(~F.col("value").rlike(RUN))).groupBy(*of_text, "value").agg(F.min("new").alias("new"))
        pieces = pieces.groupBy(of_text).agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value", "new"))).alias("pieces"))
        lists = ws.result(lists.join(as_runs, of_text, "left").join(pieces, of_text, "left"))
        plain = rows.where(F.size("found") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_replaced"), F.array().cast("array<string>").alias("kinds"))
        changed = rows.where(F.size("found") > 0).select("doc_id", "text", F.xxhash64("text").alias("h1"), F.sha1("text").alias("h2")).join(lists, of_text)
        gaps = F.split("text", ENTITY, -1)  # of the few texts with an entity only
        gaps = F.when(F.col("pieces").isNull(), gaps).otherwise(F.transform(gaps, lambda g: F.aggregate("pieces", g, lambda a, x: F.replace(a, x["value"], x["new"]))))
        word = lambda w: F.coalesce(F.try_element_at("runs", w), w)
        gaps = F.when(F.col("runs").isNull(), gaps).otherwise(F.transform(gaps, lambda g: F.array_join(F.transform(F.regexp_extract_all(g, F.lit(RUNS), F.lit(0)), word), "")))
        changed = changed.select("doc_id", F.array_join(F.zip_with(gaps, "new", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "").alias("text"), F.size("new").cast("long").alias("n_replaced"), "kinds")
        return plain.unionByName(changed)
