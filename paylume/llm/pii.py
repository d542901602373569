"""Personal data replaced by keyed surrogates of the same type and format, with DataFrame functions only.

Detected are e-mail addresses, IPv4 addresses, telephone and social-security numbers, bank card numbers (groups of
four, or 13 to 19 digits whose check digit holds), long hexadecimal secrets, and names after a title. A mention is
reduced to its entities: an address in lower case, the digits of a number, the family name and the given name of a
person. Each distinct entity gets one surrogate for the whole corpus, so that mentions of one entity stay the same,
however they are written, and different entities stay different: letters become letters and digits digits, all derived
from a keyed hash; addresses keep valid octets, card numbers keep whether their check digit holds, phone numbers their
country code, e-mail domains their last label. A name keeps its title, gets a given name of the title's gender, and
all in the value's script. Surrogates that meet another surrogate, or an entity that stands in the corpus, are drawn
again until none does; names and addresses grow with each attempt, so that they never run out.

Null texts stay null. Empty texts and texts without entities pass unchanged. Very long texts are handled whole. Repeated
rows get equal replacements; rows are matched by id and a hash of their text, so that ids may be null or repeated. All
columns of the input are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Titles by script and gender, and names that stand in for a person's (fixed values).
TITLES = {
    ("latin", "m"): ["Mr.", "Mr", "Herr", "Monsieur", "Sr.", "Señor"],
    ("latin", "f"): ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Sra.", "Señora"],
    ("cyrillic", "m"): ["Господин", "господин", "г-н"],
    ("cyrillic", "f"): ["Госпожа", "госпожа", "г-жа"],
    ("greek", "m"): ["Κύριος", "κύριος"],
    ("greek", "f"): ["Κυρία", "κυρία"],
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivo", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul", "Simon"],
    ("latin", "f"): ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Sara"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Максим", "Павел"],
    ("cyrillic", "f"): ["Алина", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("greek", "m"): ["Ανδρέας", "Γιάννης", "Κώστας", "Νίκος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
}
#: Syllables of surrogate family names by script (fixed values).
SYLLABLES = {"latin": ["ba", "de", "fo", "gu", "ka", "le", "mi", "no", "pa", "re", "sa", "ta", "va", "wo", "zi", "lu"], "cyrillic": ["ба", "ве", "го", "ду", "ка", "ле", "ми", "но"], "greek": ["βα", "γε", "δο", "κα", "λε", "μι", "νο", "πα"]}


def _name(script: str) -> str:
    """A capital with further letters of the script, inner capitals among them, and parts after hyphens and apostrophes, but
    for the s of a possessive."""
    letter = rf"[\p{{{script}}}\p{{M}}]"
    part = rf"(?:['’-](?!s(?!\p{{L}})){letter}+)"
    return rf"[\p{{{script}}}&&\p{{Lu}}](?:{letter}+{part}*|{part}+)"


_NAMES = {"latin": _name("IsLatin"), "cyrillic": _name("IsCyrillic"), "greek": _name("IsGreek")}


def _title(script: str, gender: str) -> str:
    return "(?:" + "|".join(t.replace(".", r"\.") for t in sorted(TITLES[script, gender], key=len, reverse=True)) + ")"


#: Patterns by type, tried in this order at each place.
TYPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
} | {f"name_{s}_{g}": rf"(?<![\p{{L}}]){_title(s, g)} {_NAMES[s]}(?: {_NAMES[s]})?" for s, g in TITLES}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: What every entity holds: a cheap first look.
HINT = "[0-9@]|" + "|".join(_title(s, g) for s, g in TITLES)


def kind_of(value: Column) -> Column:
    out = None
    for kind, pattern in TYPES.items():
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _digit(digest: Column, i: Column | int) -> Column:
    """Number from two hexadecimal digits of the digest, at a place that wraps around."""
    at = F.pmod((F.lit(i) if isinstance(i, int) else i) * 2, F.lit(62)) + 1
    return F.conv(F.substr(digest, at, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], digest: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(_digit(digest, i), F.lit(len(values))) + 1)


def same_format(value: Column, digest: Column) -> Column:
    """Each digit by a digit and each letter by a letter of the same case."""

    def swap(c: Column, i: Column) -> Column:
        n = _digit(digest, i)
        return (
            F.when(c.rlike("^[0-9]$"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike("^[a-z]$"), F.char(F.pmod(n, F.lit(26)) + 97))
            .when(c.rlike("^[A-Z]$"), F.char(F.pmod(n, F.lit(26)) + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def luhn(digits: Column) -> Column:
    """Sum of the check rule over a string of digits; divisible by ten when it holds."""
    reverse = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(reverse, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))), F.lit(0), lambda s, x: s + x)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_name(kind: Column) -> Column:
    return kind.startswith("name_")


def parts_of(kind: Column, value: Column) -> Column:
    """The entities of a mention: structs of ``type`` and ``entity``."""
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    number = F.when(kind == "phone", F.concat(digits_of(country), F.lit(":"), digits_of(F.substr(value, F.length(country) + 1)))).otherwise(digits_of(value))
    plain = F.when(kind == "email", F.lower(value)).when(kind.isin("phone", "ssn", "card"), number).otherwise(value)
    words = F.split(value, " ")
    script, gender = F.split_part(kind, F.lit("_"), F.lit(2)), F.split_part(kind, F.lit("_"), F.lit(3))
    pair = lambda t, e: F.struct(t.alias("type"), e.alias("entity"))
    family = pair(F.concat(F.lit("family_"), script), F.element_at(words, -1))
    given = pair(F.concat(F.lit("given_"), script, F.lit("_"), gender), F.element_at(words, -2))
    return F.when(~is_name(kind), F.array(pair(kind, plain))).when(F.size(words) > 2, F.array(family, given)).otherwise(F.array(family))


def _syllables(script: str, digest: Column, first: int, many: Column) -> Column:
    picked = F.transform(F.sequence(F.lit(first), F.lit(first - 1) + many), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), F.pmod(_digit(digest, i), F.lit(len(SYLLABLES[script]))) + 1))
    return F.initcap(F.array_join(picked, ""))


def surrogate(kind: Column, value: Column, digest: Column, attempt: Column) -> Column:
    """A replacement of one entity, from the keyed digest."""
    plain = same_format(value, digest)
    hexa = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), F.lower(F.conv(F.pmod(_digit(digest, i), F.lit(16)).cast("string"), 10, 16))).otherwise(c)), "")
    octets = F.concat_ws(".", *(F.lit(1) + F.pmod(_digit(digest, 2 * i) * 256 + _digit(digest, 2 * i + 1), F.lit(254)) for i in range(4)))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    name, last = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    # short addresses soon run out, so that later attempts add letters
    more = F.when(attempt > 2, same_format(F.repeat(F.lit("x"), attempt - 2), F.sha2(digest, 256))).otherwise(F.lit(""))
    email = F.concat(same_format(local, digest), more, F.lit("@"), same_format(name, F.reverse(digest)), F.lit("."), last)
    country = F.substring_index(value, ":", 1)
    phone = F.concat(country, F.lit(":"), same_format(F.substring_index(value, ":", -1), digest))
    body = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit("0"))
    valid = luhn(value) % 10 == 0
    check = F.pmod(-luhn(body), F.lit(10))
    check = F.when(valid, check).otherwise(F.pmod(check + 1 + F.pmod(_digit(digest, 30), F.lit(9)), F.lit(10)))
    card = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), check.cast("string"))
    out = F.when(kind == "email", email).when(kind == "ipv4", octets).when(kind == "phone", phone).when(kind == "card", card).when((kind == "secret") & value.rlike("^[0-9a-f]+$"), hexa)
    for script in SYLLABLES:
        out = out.when(kind == f"family_{script}", _syllables(script, digest, 3, attempt + 4))
    for script, gender in TITLES:
        out = out.when(kind == f"given_{script}_{gender}", F.when(attempt == 0, _pick(GIVEN[script, gender], digest, 1)).otherwise(_syllables(script, digest, 9, attempt + 2)))
    return out.otherwise(plain)


def surrogates(values: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """``type, entity, surrogate`` for distinct ``type, entity``: of one type all surrogates are distinct and none is
    an entity. Each round draws for what is left and is written, so that a lost executor costs one round."""
    done, left = [], written(values.withColumn("attempt", F.lit(0)))
    spent = left.select("type", F.col("entity").alias("surrogate"))
    for _ in range(rounds):
        digest = F.sha2(F.concat_ws("\0", F.lit(key), "type", "entity", F.col("attempt").cast("string")), 256)
        drawn = written(left.withColumn("digest", digest).withColumn("surrogate", surrogate(F.col("type"), F.col("entity"), F.col("digest"), F.col("attempt"))).drop("digest"))
        first = drawn.groupBy("type", "surrogate").agg(F.min("entity").alias("first"))
        taken = spent
        for part in done:
            taken = taken.unionByName(part.select("type", "surrogate"))
        fine = drawn.join(first, ["type", "surrogate"]).where(F.col("first") == F.col("entity")).join(taken, ["type", "surrogate"], "left_anti").select("type", "entity", "surrogate")
        done.append(written(fine))
        left = written(drawn.join(done[-1], ["type", "entity"], "left_anti").select("type", "entity", (F.col("attempt") + 1).alias("attempt")))
        if left.isEmpty():
            break
    else:
        raise ValueError("the formats hold too few values for distinct surrogates")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def rendered(kind: Column, value: Column, main: Column, given: Column) -> Column:
    """The surrogate of a mention, written as the mention is. ``main``: of its family name, else of its one entity."""
    chars = F.split(value, "")
    digits = digits_of(main)
    slots = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(digits, F.length(digits_of(F.substr(value, F.lit(1), i))) + 1, F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.zip_with(chars, F.split(main, ""), lambda c, x: F.when(c.rlike("^[A-Z]$"), F.upper(x)).otherwise(x)), "")
    title = F.split_part(value, F.lit(" "), F.lit(1))
    return F.when(is_name(kind), F.concat_ws(" ", title, given, main)).when(kind == "email", cased).when(kind.isin("phone", "ssn", "card"), slots).otherwise(main)


def replace(docs: DataFrame, key: str = "paylume") -> DataFrame:
    """The documents, all columns kept, with surrogates in ``text``."""
    return _replaced(docs, key).select("doc.*")


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    """``doc``, the document's columns, which no column of this operator can clash with, and ``n``, the number of
    entities in it."""
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = rows.select("doc", F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("\0")).alias("id"), F.xxhash64("doc.text").alias("code"))
    found = rows.select("id", "code", F.posexplode(entities(F.col("doc.text"))).alias("pos", "value")).distinct().withColumn("kind", kind_of(F.col("value")))
    found = written(found)
    mentions = found.select("kind", "value").distinct()
    # a bare number whose check digit doesn't hold is none of a card
    mentions = mentions.where(~((F.col("kind") == "card") & F.col("value").rlike("^[0-9]+$") & (luhn(digits_of(F.col("value"))) % 10 != 0)))
    parts = written(mentions.select("kind", "value", F.explode(parts_of(F.col("kind"), F.col("value"))).alias("part")).select("kind", "value", "part.*"))
    table = surrogates(parts.select("type", "entity").distinct(), key)
    is_given = F.col("type").startswith("given_")
    made = parts.join(table, ["type", "entity"]).groupBy("kind", "value").agg(F.max(F.when(~is_given, F.col("surrogate"))).alias("main"), F.max(F.when(is_given, F.col("surrogate"))).alias("given"))
    made = made.select("kind", "value", rendered(F.col("kind"), F.col("value"), F.col("main"), F.col("given")).alias("surrogate"))
    lists = found.join(made, ["kind", "value"], "left").groupBy("id", "code").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("surrogate", "value").alias("new"), F.col("surrogate").isNotNull().alias("is")))).alias("found"))
    new = F.concat(F.transform("found", lambda x: x["new"]), F.array(F.lit("")))
    text = F.array_join(F.zip_with(F.split("doc.text", PATTERN, -1), new, lambda a, b: F.concat(a, b)), "")
    n = F.size(F.filter(F.coalesce("found", F.array().cast("array<struct<pos:int,new:string,is:boolean>>")), lambda x: x["is"])).cast("long")
    joined = rows.join(lists, ["id", "code"], "left").withColumn("n", n)
    return joined.select(F.col("doc").withField("text", F.when(F.col("n") > 0, text).otherwise(F.col("doc.text"))).alias("doc"), "n")


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` with surrogates in their texts."""
    out = _replaced(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "paylume")
    return out.select("doc.doc_id", "doc.text", F.col("n").alias("n_entities"))
