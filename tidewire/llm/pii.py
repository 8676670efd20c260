"""Surrogates for personal data and secrets, in DataFrame functions only.

Detected mentions (SHAPES) get a keyed, type-consistent replacement. A replacement depends on the key, the type and the mention's
normal form alone, so every mention of one entity, in any document and spelling, gets the same one. It keeps the format: digits
stay digits, letters stay letters of the same case, marks and the country code stay, an address stays an address; a name keeps
its title and gets a name of the title's gender in the script of the original. A name runs over up to two given names or
initials, hyphens and apostrophes. Its surname and its given names are replaced apart, so a name with given names and one without
agree in the surname, and two people of one surname differ; given names become one word. Replacements are checked over all entities
of the tables: no two entities share one and none equals an original; whoever loses a tie draws again with the next
attempt, in rounds until no clash is left, and from EXTEND attempts on replacements of mail addresses and names grow by letters.

Nulls: a null text stays null and has no entities. Repeated rows, equal and null ids are rewritten alike. Empty tables give no rows. `rewritten` keeps
all further columns whatever they are called. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.workspace import Rounds

# Titles by gender, syllables and endings of names by script.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία")
SYLLABLES = {
    "latin": ("ba", "da", "fe", "ga", "ha", "ju", "ka", "le", "mi", "no", "pa", "ro", "sa", "te", "vi", "zo"),
    "cyrillic": ("ба", "да", "фе", "га", "ха", "ву", "ка", "ле", "ми", "но", "па", "ро", "са", "те", "ви", "зо"),
    "greek": ("βα", "δα", "φε", "γα", "χα", "θυ", "κα", "λε", "μι", "νο", "πα", "ρο", "σα", "τε", "ψι", "ζο"),
}
ENDINGS = {"latin": ("n", "na"), "cyrillic": ("н", "на"), "greek": ("ς", "να")}

#: a capitalised word of a name, and a name: up to two given names or initials and a surname
WORD = r"\p{Lu}(?:\p{Ll}+|(?=['’]))(?:['’\-]?\p{Lu}\p{Ll}+)*"
NAME = rf"(?:(?:\p{{Lu}}\.|{WORD}) ){{0,2}}{WORD}"
HEX = "[0-9A-Fa-f]{1,4}"

#: type -> pattern; the first that fits names a mention's type
SHAPES = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "token": r"\b[0-9a-f]{40}\b",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}[ \-]?[0-9]{4}"
    r"|\+(?=(?:[ .\-]?[0-9]){9,15}(?![0-9]))[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?:\b[0-9]{3}-|\([0-9]{3}\) ?)[0-9]{3}-[0-9]{4}\b",
    "card": r"\b[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "address": r"\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b",
    # global, local and link addresses of version 6: eight groups, or fewer with a double colon
    "address6": rf"\b(?:[23][0-9A-Fa-f]{{3}}|[fF][c-eC-E][0-9A-Fa-f]{{2}})(?=[0-9A-Fa-f:]*::|(?::{HEX}){{7}}\b)(?:::?{HEX}){{1,7}}\b",
    "name": "(?:" + "|".join(MALE + FEMALE) + rf")\.? {NAME}",
}
ANY = "(" + "|".join(f"(?:{p})" for p in SHAPES.values()) + ")"
ATTEMPTS, EXTEND = 64, 4


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(1))


def kind_of(mention: Column) -> Column:
    kinds = list(SHAPES)
    out = F.when(mention.rlike(f"^(?:{SHAPES[kinds[0]]})$"), kinds[0])
    for k in kinds[1:]:
        out = out.when(mention.rlike(f"^(?:{SHAPES[k]})$"), k)
    return out


def normal_form(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "name", F.concat_ws(" ", _title(mention), F.substring_index(mention, " ", -1)))
        .when(kind == "address6", F.lower(mention))
        .otherwise(mention)
    )


def _title(mention: Column) -> Column:
    return F.regexp_replace(F.substring_index(mention, " ", 1), r"\.", "")


def given_names(kind: Column, mention: Column) -> Column:
    """Title and given names of a name, null for mentions without given names."""
    given = F.regexp_extract(mention, r"^\S+ (.*) \S+$", 1)
    return F.when((kind == "name") & (given != ""), F.concat_ws(" ", _title(mention), given))


def _number(digest: Column, i: Column | int, below: int) -> Column:
    """The i-th number of a hex digest, below `below`."""
    at = (F.lit(i) if isinstance(i, int) else i) * 3 % 120 + 1
    return (F.conv(F.substr(digest, at.cast("int"), F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _pick(letters: str, digest: Column, i: Column) -> Column:
    return F.substr(F.lit(letters), _number(digest, i, len(letters)) + 1, F.lit(1))


LOWERCASE = "abcdefghijklmnopqrstuvwxyz"


def surrogate_form(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """Replacement of a normal form."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, attempt.cast("string")), 512)
    chars = F.split(normal, "")
    more = F.greatest(F.lit(0), attempt - EXTEND + 1)
    # letters of the last label of a mail domain stay, so do the country code of a phone and the key's prefix
    fixed_to = F.when(kind.isin("key", "address6"), 4).when((kind == "phone") & (F.length(normal) > 10), F.length(normal) - 10).otherwise(0)
    fixed_from = F.when(kind == "email", F.length(normal) - F.length(F.substring_index(normal, ".", -1))).otherwise(F.length(normal))
    hexed = kind.isin("token", "address6")

    def drawn(c: Column, i: Column) -> Column:
        return (
            F.when((i < fixed_to) | (i >= fixed_from) | (c == ":"), c)
            .when(hexed, _pick("0123456789abcdef", digest, i))
            .when(c.rlike("[0-9]"), _pick("0123456789", digest, i))
            .when(c.rlike("[a-z]"), _pick(LOWERCASE, digest, i))
            .when(c.rlike("[A-Z]"), _pick(LOWERCASE.upper(), digest, i))
            .otherwise(c)
        )

    letters = F.concat_ws("", F.transform(F.sequence(F.lit(40), F.lit(40) + more), lambda i: _pick(LOWERCASE, digest, i)))
    letters = F.when(more > 0, letters).otherwise("")
    plain = F.concat_ws("", F.transform(chars, drawn))
    address = F.concat_ws(".", *[(_number(digest, i, 254) + 1).cast("string") for i in range(4)])
    given = F.substring_index(normal, " ", -1)
    female = F.substring_index(normal, " ", 1).isin(*FEMALE)

    def name(script: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        body = F.concat_ws("", *[F.element_at(syllables, _number(digest, i, 16) + 1) for i in range(4)])
        extra = F.when(more > 0, F.concat_ws("", F.transform(F.sequence(F.lit(8), F.lit(8) + more), lambda i: F.element_at(syllables, _number(digest, i, 16) + 1)))).otherwise("")
        male, fem = ENDINGS[script]
        return F.concat(F.substring_index(normal, " ", 1), F.lit(" "), F.initcap(F.concat(body, extra, F.when(female, fem).otherwise(male))))

    names = F.when(given.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(given.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    return (
        F.when(kind.isin("name", "given"), names)
        .when(kind == "address", address)
        .when(kind == "email", F.concat(letters, plain))
        .otherwise(plain)
    )


def in_format(kind: Column, mention: Column, form: Column, given: Column) -> Column:
    """The replacement of a normal form, and of the given names if there are any, written like this mention."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    # digits of the form take the places of the mention's digits
    spread = F.aggregate(
        F.split(mention, ""),
        start,
        lambda acc, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substr(form, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))),
        lambda acc: acc["s"],
    )
    name = F.concat_ws(" ", F.substring_index(mention, " ", 1), F.substring_index(given, " ", -1), F.substring_index(form, " ", -1))
    return (
        F.when(kind.isin("phone", "card", "ssn"), spread)
        .when(kind == "name", name)
        .when((kind == "email") & (mention == F.upper(mention)), F.upper(form))
        .otherwise(form)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, normal), distinct -> (kind, normal, form) with distinct forms that equal no normal form."""
    rounds = Rounds(entities.sparkSession, "surrogates")
    state = entities.withColumn("attempt", F.lit(0))
    state = rounds.save(state.withColumn("form", surrogate_form(F.col("kind"), F.col("normal"), F.col("attempt"), key)))
    for _ in range(ATTEMPTS):
        holders = state.groupBy("kind", "form").agg(F.min("normal").alias("holder"), F.count(F.lit(1)).alias("n"))
        taken = state.select("kind", F.col("normal").alias("form"), F.lit(True).alias("taken"))
        clashing = (
            holders.join(taken, ["kind", "form"], "left").filter("n > 1 or taken").withColumn("holder", F.when(F.col("taken").isNull(), F.col("holder")))
        ).select("kind", "form", "holder", F.lit(True).alias("clash"))
        if clashing.isEmpty():
            return state.select("kind", "normal", "form")
        again = state.join(clashing, ["kind", "form"], "left")
        lost = F.col("clash").isNotNull() & ~F.coalesce(F.col("normal") == F.col("holder"), F.lit(False))
        attempt = F.col("attempt") + lost.cast("int")
        form = F.when(lost, surrogate_form(F.col("kind"), F.col("normal"), attempt, key)).otherwise(F.col("form"))
        before, state = state, rounds.save(again.select("kind", "normal", attempt.alias("attempt"), form.alias("form")))
        rounds.drop(before)
    raise ValueError(f"surrogates still clash after {ATTEMPTS} attempts")


def rewritten(docs: DataFrame, key: str, out: str = "entities") -> DataFrame:
    """docs with `text` rewritten, and an array column `out` of the (kind, form) of its entities in order."""
    spark = docs.sparkSession
    mark = "_pii"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    text, found, list_key = F.col("text").cast("string"), f"{mark}_found", f"{mark}_key"
    rows = docs.withColumn(found, F.coalesce(mentions(text), F.array().cast("array<string>")))
    # documents with the same mentions share one entry; those without any need no partner and are spread by their text
    joined = F.concat_ws("\x01", found)
    rows = rows.withColumn(list_key, F.when(F.size(found) > 0, F.md5(joined)).otherwise(F.xxhash64(text).cast("string")))
    lists = rows.filter(F.size(found) > 0).select(F.col(list_key).alias("k"), F.col(found).alias("m")).dropDuplicates(["k"])
    lists = Rounds(spark, "mentions").save(lists)
    each = lists.select("k", F.posexplode("m").alias("i", "mention"))
    kinds = each.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    kinds = kinds.withColumn("normal", normal_form(F.col("kind"), F.col("mention"))).withColumn("given", given_names(F.col("kind"), F.col("mention")))
    entities = kinds.select("kind", "normal").unionByName(kinds.filter("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("normal")))
    forms = surrogates(entities.distinct(), key)
    firsts = forms.filter("kind = 'given'").select(F.col("normal").alias("given"), F.col("form").alias("first"))
    written = kinds.join(forms, ["kind", "normal"]).join(firsts, "given", "left").select(
        "mention", "kind", in_format(F.col("kind"), F.col("mention"), F.col("form"), F.col("first")).alias("form")
    )
    replaced = (
        each.join(written, "mention").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "kind", "form"))).alias("r"))
    )
    replaced = replaced.select(F.col("k").alias(f"{mark}_k"), F.col("r").alias(f"{mark}_r"))
    both = rows.join(replaced, F.col(list_key) == F.col(f"{mark}_k"), "left")
    given = F.transform(F.col(f"{mark}_r"), lambda x: x["form"])
    parts = F.split(text, ANY, -1)
    woven = F.concat_ws("", F.zip_with(parts, given, lambda p, g: F.concat(p, F.coalesce(g, F.lit("")))))
    keep = [F.when(F.col(f"{mark}_r").isNull(), text).otherwise(woven).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != out]
    entities = F.transform(F.col(f"{mark}_r"), lambda x: F.struct(x["kind"].alias("kind"), x["form"].alias("form")))
    return both.select(*keep, F.coalesce(entities, F.array().cast("array<struct<kind:string,form:string>>")).alias(out))
