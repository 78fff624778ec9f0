"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern, split into atoms (the local part and the domain of an e-mail address, the given
name and the surname of a person, the digits of a number), and every distinct atom of the corpus gets one surrogate
from a keyed hash. Equal atoms get equal surrogates everywhere, so mentions of one person or host still agree; a
collision check gives distinct atoms distinct surrogates, none of which is itself an atom of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursepath.llm.tables import free_name, stored, text_or_empty

# Titles and given names by gender; names of a list stand in for each other.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "г-н", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа")
NEUTRAL_TITLES = ("Dr", "Prof")
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Thomas Daniel Paul Peter Hans Jürgen Pierre Jean Carlos José Juan Miguel".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Laura Ursula Monika Marie Claire María Carmen Lucía Sofía".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
# Syllables that made-up surnames and given names consist of.
SYLLABLES = {
    "latin": "ba be bo da del den do fa fer gan gor hal han hol jo kar kel lan lem lor mar mel mon nar nel nor pal per ral ren rod sal sen sol tan tel tor val ver vin".split(),
    "cyrillic": "ба бо ва вел га гор да дол жи за зор ка кол ла лен ма мир на нов ол па пет ра род са сев та тор фе хо".split(),
}
ENDINGS = {("m", "latin"): "o", ("f", "latin"): "a", ("n", "latin"): "i", ("m", "cyrillic"): "ил", ("f", "cyrillic"): "ина", ("n", "cyrillic"): "и"}
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшщэюя"

_TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES)
_LISTED = "|".join(n for names in GIVEN.values() for n in names)
_NAME = r"\p{Lu}[\p{L}'\-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9\-]{20,})(?![\p{L}\p{N}])",
    "phone": r"(?<![\w+.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}(?!\w)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?!\w)",
    "person": rf"(?=[\p{{Lu}}г])(?<!\p{{L}})(?:(?:{_TITLE})\.?[ ]{_NAME}(?:[ ]{_NAME})?|(?:{_LISTED})[ ]{_NAME})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every entity but a person holds one of these, so that most texts need no look at the long pattern.
_SIGNS = r"[0-9@]|[a-f]{32}|[A-F]{32}|AKIA|ghp_|sk-|xox[bp]-"
_PRIVATE = r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)"
_DIGITS = ("phone", "ssn", "card")
_FIXED_LENGTH = ("phone", "ssn", "card", "ip", "secret")


@dataclass(frozen=True)
class SurrogateParams:
    key: str  # secret; the same key gives the same surrogates
    longer_after: int = 8  # attempts after which a free-length surrogate grows, so that a free one exists
    most_attempts: int = 60


def _whole(kind: str) -> Column:
    return F.col("raw").rlike(f"^(?:{PATTERNS[kind]})$")


def _parts(raw: DataFrame) -> DataFrame:
    """``raw`` entities as literal text around at most two atoms: pre, atom 1, mid, atom 2, post."""
    title = rf"^((?:{_TITLE})\.?) "
    kinds = F.when(F.col("raw").contains("@"), "email")
    for kind in ("ip", "secret", "ssn", "phone", "card"):
        kinds = kinds.when(_whole(kind), kind)
    df = raw.withColumn("type", kinds.otherwise("person"))
    name = F.regexp_replace("raw", title, "")
    names = F.split(name, " ")
    given = F.when(F.size(names) > 1, names[0])
    surname = F.element_at(names, -1)
    script = lambda c: F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    titled = F.regexp_extract("raw", title, 1)
    bare = F.regexp_replace(titled, r"\.$", "")
    gender = F.when(bare.isin(*MALE_TITLES), "m").when(bare.isin(*FEMALE_TITLES), "f")
    for (g, _), listed in GIVEN.items():
        gender = gender.when(given.isin(*listed), g)
    gender = gender.otherwise("n")
    mail, code = r"^(.*)@(.*)(\.[A-Za-z]+)$", r"^(\+\d{1,3}[ .\-]?)"
    is_ = lambda t: F.col("type") == t
    return df.select(
        "raw",
        F.when(is_("phone"), F.regexp_extract("raw", code, 1)).when(is_("person") & (titled != ""), F.concat(titled, F.lit(" "))).otherwise("").alias("pre"),
        F.when(is_("email"), "local").when(is_("person"), F.when(given.isNotNull(), F.concat_ws("_", F.lit("given"), gender, script(given)))).otherwise(F.col("type")).alias("kind1"),
        F.when(is_("email"), F.regexp_extract("raw", mail, 1)).when(is_("person"), given).when(is_("phone"), F.regexp_replace("raw", code, "")).otherwise(F.col("raw")).alias("atom1"),
        F.when(is_("email"), "@").when(is_("person") & given.isNotNull(), " ").otherwise("").alias("mid"),
        F.when(is_("email"), "domain").when(is_("person"), F.concat_ws("_", F.lit("surname"), script(surname))).alias("kind2"),
        F.when(is_("email"), F.regexp_extract("raw", mail, 2)).when(is_("person"), surname).alias("atom2"),
        F.when(is_("email"), F.regexp_extract("raw", mail, 3)).otherwise("").alias("post"),
    )


def _canon(kind: Column, atom: Column) -> Column:
    """The form that equal entities share: digits only for numbers, lower case for the rest."""
    return F.when(kind.isin(*_DIGITS), F.regexp_replace(atom, r"\D", "")).otherwise(F.lower(atom))


def _stream(key: str) -> Column:
    """512 keyed hexadecimal digits for (kind, canon, attempt)."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.col("attempt").cast("string"), F.lit(str(k))), 512) for k in range(4)))


def _number(i: Column) -> Column:
    """The i-th (from 0) 16-bit number of the stream, which is read in a circle."""
    return F.conv(F.substring(F.col("stream"), F.pmod(i * 4, F.lit(508)) + 1, F.lit(4)), 16, 10).cast("int")


def _shaped() -> Column:
    """``canon`` with letters for letters of its script and digits for digits; other characters stay."""

    def one(i: Column) -> Column:
        c, v = F.substring(F.col("canon"), i + 1, F.lit(1)), _number(i)
        return (
            F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), F.substring(F.lit(_CYRILLIC), v % len(_CYRILLIC) + 1, F.lit(1)))
            .when(c.rlike(r"\p{L}"), F.chr(v % 26 + 97))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.expr("sequence(0, length(canon) - 1)"), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _surrogate(params: SurrogateParams) -> Column:
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    shaped = _shaped()
    # The issuer digit stays, and so does whether the check digit is right.
    card = F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(shaped, F.lit(2), F.length(canon) - 2))
    check = F.pmod(10 - _luhn(F.concat(card, F.lit("0"))), F.lit(10))
    last = F.when(_luhn(canon) == 0, check).otherwise(F.pmod(check + 1 + _number(F.lit(60)) % 9, F.lit(10)))
    # The exchange 555 marks a number as fictional; it stays as long as free numbers are found.
    area, line = F.substring(shaped, F.lit(1), F.lit(3)), F.substring(shaped, F.lit(7), F.lit(4))
    fictional = (kind == "phone") & canon.rlike(r"^\d{3}555\d{4}$") & (attempt < params.longer_after)
    private = F.regexp_extract("canon", _PRIVATE, 1)
    octets = F.concat_ws(".", (_number(F.lit(0)) % 191 + 11).cast("string"), *((_number(F.lit(k)) % 254 + 1).cast("string") for k in (1, 2, 3)))
    kept = F.size(F.split(private, r"\.")) - 1
    ip = F.when(private != "", F.concat(private, F.array_join(F.slice(F.split(octets, r"\."), kept + 1, 4 - kept), "."))).otherwise(octets)
    hexa = F.substring(F.array_join(F.array_repeat(F.col("stream"), F.ceil(F.length(canon) / 512).cast("int")), ""), F.lit(1), F.length(canon))
    made = lambda script, n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), _number(i) % len(SYLLABLES[script]) + 1)), "")
    longer = F.greatest(F.lit(0), attempt - params.longer_after)
    out = F.when(kind == "card", F.concat(card, last.cast("string"))).when(kind == "ip", ip)
    out = out.when(fictional, F.concat(area, F.lit("555"), line))
    out = out.when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), hexa)
    out = out.when(kind.isin("local", "domain"), F.concat(shaped, F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.chr(_number(i + 70) % 26 + 97)), ""), F.lit(1), longer)))
    for script in SYLLABLES:
        out = out.when(kind == f"surname_{script}", made(script, 3 + longer))
        for gender in "mfn":
            listed = GIVEN.get((gender, script))
            free = F.concat(made(script, 2 + longer), F.lit(ENDINGS[gender, script]))
            if listed:
                names = F.array(*(F.lit(n.lower()) for n in listed))
                at = F.array_position(names, canon).cast("int")
                # Another name of the list: all move on by the same keyed number of places.
                places = F.conv(F.substring(F.sha2(F.lit(f"{params.key}\x1f{gender}{script}"), 256), F.lit(1), F.lit(4)), 16, 10).cast("int") % (len(listed) - 1) + 1
                free = F.when((at > 0) & (attempt == 0), F.element_at(names, F.pmod(at - 1 + places, F.lit(len(listed))) + 1)).otherwise(free)
            out = out.when(kind == f"given_{gender}_{script}", free)
    return out.otherwise(shaped)


def assign_surrogates(atoms: DataFrame, params: SurrogateParams) -> DataFrame:
    """``(kind, canon, surrogate)`` for distinct atoms: surrogates are distinct within a kind and no atoms themselves.

    Listed given names take names of the same list, which the corpus may hold too; all move by the same number of places, so they stay
    distinct. Of atoms that want one surrogate, the least keeps it and the others try again. A format of fixed length may have no values left, as
    when a corpus holds every address of 192.168; its atoms that are left then take each other's places, each the next one's.
    """
    everyone = stored(atoms.select("kind", "canon").distinct(), "atoms")
    pending, done = everyone, None
    for attempt in range(params.most_attempts):
        tried = stored(
            pending.withColumn("attempt", F.lit(attempt)).withColumn("stream", _stream(params.key)).withColumn("surrogate", _surrogate(params)).select("kind", "canon", "surrogate"),
            "surrogates",
        )
        listed = F.col("kind").isin(*(f"given_{g}_{s}" for g, s in GIVEN)) if attempt == 0 else F.lit(False)
        taken = everyone.select("kind", F.col("canon").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        first = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        free = first.where(~listed).join(taken, ["kind", "surrogate"], "left_anti").unionByName(first.where(listed))
        won = stored(free.select("kind", "canon", "surrogate"), "surrogates_assigned")
        done = won if done is None else stored(done.unionByName(won), "surrogates_assigned")
        pending = stored(tried.select("kind", "canon").join(won, ["kind", "canon"], "left_anti"), "atoms_pending")
        if pending.isEmpty():
            return done
        if attempt >= params.longer_after and won.where(F.col("kind").isin(*_FIXED_LENGTH)).isEmpty() and pending.where(~F.col("kind").isin(*_FIXED_LENGTH)).isEmpty():
            break
    return done.unionByName(_rotated(pending, everyone))


def _format(kind: Column, canon: Column) -> Column:
    """What a surrogate of fixed length keeps, so that atoms of one format can stand for each other."""
    shape = F.regexp_replace(F.regexp_replace(canon, r"\d", "0"), "[a-z]", "a")
    private = F.regexp_extract(canon, _PRIVATE, 1)
    card = F.concat_ws(" ", F.length(canon).cast("string"), F.substring(canon, F.lit(1), F.lit(1)), (_luhn(canon) == 0).cast("string"))
    form = F.when(kind == "ip", private).when(kind == "card", card).when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), F.length(canon).cast("string")).otherwise(shape)
    return F.concat_ws(" ", kind, form)


def _rotated(pending: DataFrame, everyone: DataFrame) -> DataFrame:
    """Each atom gets the next one of its format, the last the first: distinct, none its own, and no surrogate given before.

    Formats are rotated in rings of some 50,000 atoms. An atom alone in its ring joins the others that are alone, and one
    that is alone in all takes the least other atom of its format.
    """
    marked = pending.withColumn("format", _format(F.col("kind"), F.col("canon")))
    rings = marked.groupBy("format").agg(F.ceil(F.count("*") / 50_000).alias("rings"))
    placed = stored(marked.join(rings, "format").withColumn("ring", F.pmod(F.xxhash64("canon"), "rings")), "atoms_of_full_formats")

    def next_of(df: DataFrame) -> DataFrame:
        ring = Window.partitionBy("format", "ring").orderBy("canon")
        size, whole = F.count("*").over(Window.partitionBy("format", "ring")), ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        following = F.coalesce(F.lead("canon").over(ring), F.first("canon").over(whole))
        return df.withColumn("surrogate", F.when(size > 1, following))

    first = next_of(placed)
    second = next_of(first.where("surrogate is null").drop("surrogate").withColumn("ring", F.lit(0).cast("long")))
    alone = second.where("surrogate is null").drop("surrogate")
    others = everyone.where(F.col("kind").isin(*_FIXED_LENGTH)).select(_format(F.col("kind"), F.col("canon")).alias("format"), F.col("canon").alias("other"))
    taken = alone.join(others, "format").where("canon <> other").groupBy("kind", "canon").agg(F.min("other").alias("surrogate"))
    done = first.where("surrogate is not null").unionByName(second.where("surrogate is not null"))
    return done.select("kind", "canon", "surrogate").unionByName(taken)


def _rendered(kind: Column, atom: Column, surrogate: Column) -> Column:
    """The surrogate in the layout of the atom: its separators, or its case."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(atom, F.lit(1), i), r"\D", ""))
    digit = lambda i: F.when(F.substring(atom, i, F.lit(1)).rlike("[0-9]"), F.substring(surrogate, nth(i), F.lit(1))).otherwise(F.substring(atom, i, F.lit(1)))
    laid_out = F.array_join(F.transform(F.sequence(F.lit(1), F.length(atom)), digit), "")
    upper = (F.upper(atom) == atom) & (F.lower(atom) != atom)
    title = F.concat(F.upper(F.substring(surrogate, F.lit(1), F.lit(1))), F.substring(surrogate, F.lit(2), F.length(surrogate)))
    named = kind.startswith("given") | kind.startswith("surname")
    return F.when(kind.isin(*_DIGITS), laid_out).when(upper & (F.length(atom) > 1), F.upper(surrogate)).when(named, title).otherwise(surrogate)


def replace_pii(docs: DataFrame, params: SurrogateParams, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced; ``count`` names a column for how many there were.

    Rows without entities, nulls and empty texts included, stay as they are, and so do all other columns, repeated
    rows and null ids. Text between entities is unchanged. If a column ``n_chars`` exists, a changed row gets its new length.
    """
    found, key, new = (free_name(docs, c) for c in ("entities", "entity_key", "replacements"))
    body = F.col(f"`{text}`")
    whole_text, person = text_or_empty(text), PATTERNS["person"]
    signs = whole_text.rlike(_SIGNS)
    entities = (
        F.when(signs, F.regexp_extract_all(whole_text, F.lit(ANY), 0))
        .when(whole_text.rlike(person), F.regexp_extract_all(whole_text, F.lit(person), 0))
        .otherwise(F.array().cast("array<string>"))
    )
    marked = docs.withColumn(found, entities)
    clean = marked.where(F.size(found) == 0).drop(found)
    dirty = stored(marked.where(F.size(found) > 0).withColumn(key, F.md5(F.array_join(found, "\x1f"))), "documents_with_entities")

    lists = dirty.groupBy(F.col(key).alias("key")).agg(F.first(found).alias("raws"))
    mentions = stored(lists.select("key", F.posexplode("raws").alias("pos", "raw")), "mentions")
    parts = stored(_parts(mentions.select("raw").distinct()), "entities")
    one, two = (
        parts.select(F.col(f"kind{k}").alias("kind"), _canon(F.col(f"kind{k}"), F.col(f"atom{k}")).alias("canon")).where("kind is not null")
        for k in (1, 2)
    )
    names = assign_surrogates(one.unionByName(two), params)
    out = parts
    for k in (1, 2):
        mine = names.select(F.col("kind").alias(f"kind{k}"), F.col("canon").alias(f"canon{k}"), F.col("surrogate").alias(f"surrogate{k}"))
        out = out.withColumn(f"canon{k}", _canon(F.col(f"kind{k}"), F.col(f"atom{k}"))).join(mine, [f"kind{k}", f"canon{k}"], "left")
    shown = lambda k: F.coalesce(_rendered(F.col(f"kind{k}"), F.col(f"atom{k}"), F.col(f"surrogate{k}")), F.lit(""))
    replaced = out.select("raw", F.concat("pre", shown(1), "mid", shown(2), "post").alias("out"))
    row = F.array_sort(F.collect_list(F.struct("pos", "out")))
    by_key = stored(
        mentions.join(replaced, "raw").groupBy(F.col("key").alias(key)).agg(F.transform(row, lambda x: x["out"]).alias(new)),
        "replacements",
    )
    # Split by the pattern that the entities were found with, so that pieces and replacements line up.
    pieces = F.when(signs, F.split(body, ANY, -1)).otherwise(F.split(body, person, -1))
    whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(new), F.get(F.col(new), i)).otherwise(""))), "")
    changed = dirty.join(by_key, key).withColumn(text, whole)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    if count:
        clean, changed = clean.withColumn(count, F.lit(0)), changed.withColumn(count, F.size(found))
    names_out = [f"`{c}`" for c in clean.columns]
    return clean.unionByName(changed.select(*names_out))
