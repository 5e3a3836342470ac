"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent. DataFrame functions only.

One pass finds the entities of each whole text (e-mail and IP addresses, phone, card, social-security and account
numbers, access keys, assigned secrets, names after an honorific). Each distinct entity gets one surrogate for the
whole corpus, drawn from a keyed digest of (type, entity, attempt) in the entity's own format: digits stay digits,
letters keep case and script, separators and prefixes stay, cards keep a valid check digit, names keep gender (by
honorific; after Dr. and Prof. alone it is open) and script, IBANs keep a valid check number, mails of one domain keep a common
domain. Surrogates belong to a normal form, over which the format of each occurrence is laid: cards, phone, social-security and
account numbers without separators, mails in lower case. A name that was found once is found again in its document without its
honorific, as a whole and by its last word (not by its first one alone: that would take words at the start of sentences).

Collision checks: a draw that two entities share goes to one of them; a draw that is itself an entity of the corpus goes
to none. The others draw again until none is left, so distinct entities stay distinct, and equal ones equal, in every
document. Domains of mails are entities of their own (whatever their case) and are settled first, so distinct ones stay
distinct. No space of surrogates is empty or stays full, so the draws end: letters of other alphabets, and all of a secret
without letters and digits, are drawn from a known alphabet; names gain a syllable with each attempt, and after some failed
attempts secrets, keys, mails and numbers gain a character with each. Cards and IP addresses keep their length, 1e11 and 4e9
of a kind, until ``LAST`` draws have failed, as where a corpus uses up nearly all of them; then they gain digits too.
The map is joined to the documents by entity, never collected, and only texts with entities are shuffled.

Defined cases: null and empty texts and texts without entities are unchanged; all rows and columns are kept (n_chars
follows the text where there is such a column); equal rows change alike; entities never cross documents; columns of any
name are carried as they are, but for one named as ``count_col``, which the count replaces.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

_SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:][ ]?[\"']?"
_MALE, _FEMALE = r"(?:Mr|Herr|Monsieur|Señor|Sr|Г-н)", r"(?:Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Srta|Sra|Г-жа)"
_TITLE = r"(?:Dr|Prof)"
_HONORIFIC = rf"(?:(?:{_FEMALE}|{_MALE}|{_TITLE})\.?[ ]){{1,3}}"
_WORD = r"\p{Lu}(?=['’-]?\p{L})\p{Ll}*(?:['’-]?\p{Lu}\p{Ll}+|['’-]\p{Ll}{2,})*"
_NAME = rf"{_WORD}(?:[ ]{_WORD})?"

#: All kinds in one alternation behind one boundary, so most positions fail on one character.
PATTERN = (
    r"(?<![\p{L}\p{N}])(?:"
    + "|".join([
        _SECRET + r"[^\s\"'<>]{6,}",
        r"[A-Za-z0-9À-ɏ][A-Za-z0-9À-ɏ._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]*[A-Za-z0-9])++",
        r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
        r"(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,})",
        r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
        r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"\+?[0-9]{0,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
        r"\+[0-9]{1,3}[ .-][0-9](?:[ .-]?[0-9]){6,13}(?![0-9])",
        r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9-])",
        _HONORIFIC + _NAME,
    ])
    + ")"
)

#: After a name that is looked for again: no more of a word, and no address of a mail.
_MENTION_END = r"(?![\p{L}\p{N}])(?![A-Za-z0-9À-ɏ._%+-]*+@)"

#: Given names by gender and script (fixed values); family names are built from the syllables.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul".split(),
    ("f", "latin"): "Alma Berta Clara Diana Emma Flora Greta Helena Iris Julia Karin Lena Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман Семён".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина Раиса София".split(),
}
SYLLABLES = {"latin": "ba ben dor fel gar hol kan lin mar nor pel ram sol tur vel wen".split(), "cyrillic": "ба бен дор фел гар хол кан лин мар нор пел рам сол тур вел вен".split()}

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäèéêëìíîïòóôöùúûüñç", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜÑÇ", "āăąćčďđēėęěğģīįķļłńņňőřśşšťţūůűųźżž", "ĀĂĄĆČĎĐĒĖĘĚĞĢĪĮĶĻŁŃŅŇŐŘŚŞŠŤŢŪŮŰŲŹŻŽ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ")
_DIGITS, _SMALL, _CAPITAL = _ALPHABETS[:3]
#: Failed attempts after which a surrogate gets longer than its entity: of letters, and of digits only.
LONGER, LONGER_NUMBER = 4, 16
#: Draws after which cards and IP addresses give up their format to stay distinct.
LAST = 40


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.rlike(f"^{_SECRET}"), "secret").when(entity.contains("@"), "mail").when(entity.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
        .when(entity.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk-)"), "key").when(entity.rlike(rf"^(?:{_TITLE}\.?[ ])*{_FEMALE}\.?[ ]"), "name_f").when(entity.rlike(rf"^(?:{_TITLE}\.?[ ])*{_MALE}\.?[ ]"), "name_m").when(entity.rlike(rf"^{_TITLE}\.?[ ]"), "name_u")
        .when(entity.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(entity.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(entity.rlike("^[0-9][0-9 -]*$") & (F.length(F.regexp_replace(entity, "[ -]", "")) >= 13), "card")
        .otherwise("phone"))


def prefix_of(entity: Column, kind: Column) -> Column:
    """What stays as it is in front of the part that identifies someone."""
    return (
        F.when(kind == "secret", F.regexp_extract(entity, f"^({_SECRET})", 1)).when(kind.startswith("name"), F.regexp_extract(entity, f"^({_HONORIFIC})", 1))
        .when(kind == "key", F.regexp_extract(entity, "^(AKIA|ASIA|gh[pousr]_|sk-)", 1)).when(kind == "phone", F.regexp_extract(entity, r"^(\+[0-9]{0,3})", 1))
        .otherwise(""))


def normal(core: Column, kind: Column) -> Column:
    """What all occurrences of an entity have in common, whatever their format."""
    bare = F.regexp_replace(core, r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("card", "iban", "phone", "ssn"), bare).when(kind == "mail", F.lower(core)).otherwise(core)


def laid(core: Column, kind: Column, new: Column) -> Column:
    """The surrogate of a normal form in the format of an occurrence: its separators, or the case of its letters."""
    chars = F.split(core, "")
    nth = lambda i: F.length(F.regexp_replace(F.substring(core, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    spread = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(new, nth(i), F.lit(1))).otherwise(c)), "")
    spread = F.concat(spread, F.substring(new, nth(F.length(core)) + 1, F.length(new)))
    cased = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(core, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    mail = F.when(core == F.lower(core), new).when(core == F.upper(core), F.upper(new)).otherwise(cased)
    return F.when(kind.isin("card", "iban", "phone", "ssn"), spread).when(kind == "mail", mail).otherwise(new)


def _mod97(iban: Column) -> Column:
    """1 of an IBAN whose check number is right."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _digest(key: str, *parts: Column) -> Column:
    """128 bytes as hex."""
    said = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(F.sha2(said, 512), F.sha2(F.concat(said, F.lit("|more")), 512))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, digest: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), _byte(digest, i) % len(letters) + 1, F.lit(1))


def _redraw(text: Column, digest: Column) -> Column:
    """Each digit or letter by another of its own alphabet, or of a Latin one if its own is not known; all else as it
    is, unless there is nothing but that."""
    hex_ = text.rlike("^[0-9a-f]+$") & text.rlike("[a-f]") & text.rlike("[0-9]")
    bare = ~text.rlike(r"[\p{L}\p{N}]")

    def char(c, i):
        out = F.when(c.rlike(r"\p{Lu}"), _pick(_CAPITAL, digest, i)).when(bare | c.rlike(r"[\p{L}\p{M}\p{N}]"), _pick(_SMALL, digest, i)).otherwise(c)
        for letters in reversed(_ALPHABETS):
            out = F.when(F.lit(letters).contains(c), _pick(letters, digest, i)).otherwise(out)
        return F.when(hex_, _pick("0123456789abcdef", digest, i)).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _more(letters: str, digest: Column, n: int) -> Column:
    """n letters, from the end of the digest."""
    return F.concat(F.lit(""), *(_pick(letters, digest, F.lit(127 - i % 128)) for i in range(n)))


def _check_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counting once."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def draws(key: str, kind: Column, core: Column, attempt: int) -> dict[str, Column]:
    """Keyed digests that a surrogate is made from: of the entity, and of the parts that it shares with others."""
    again = F.lit(str(attempt) if attempt else "")
    return {
        "_draw": _digest(key, kind, core, F.lit(str(attempt))),
        "_given": _digest(key, F.lit("given"), kind, F.substring_index(core, " ", 1), again), "_family": _digest(key, F.lit("family"), F.substring_index(core, " ", -1), again),
    }


def surrogate(kind: Column, core: Column, attempt: int = 0) -> Column:
    """Of an entity whose draws, and the surrogate of whose domain if it is a mail, are columns beside it."""
    draw = F.col("_draw")
    plain = _redraw(core, draw)
    last = _more(_DIGITS, draw, max(0, attempt - LAST + 1))
    letters, longer = _more(_SMALL, draw, max(0, attempt - LONGER + 1)), _more(_DIGITS, draw, max(0, attempt - LONGER_NUMBER + 1))

    mail = F.concat(_redraw(F.substring_index(core, "@", 1), draw), letters, F.lit("@"), F.col("domain"))
    domain = F.concat(_redraw(F.regexp_extract(core, r"^(.*)\.[^.]*$", 1), draw), letters, F.lit("."), F.substring_index(core, ".", -1))

    ip = F.array_join(F.transform(F.split(core, r"\."), lambda c, i: (_byte(draw, i) % 254 + 1).cast("string")), ".")

    digits, new = F.regexp_replace(core, "[^0-9]", ""), F.regexp_replace(plain, "[^0-9]", "")
    new = F.concat(F.substring(digits, 1, 1), F.substring(new, F.lit(2), F.length(new)))
    body = F.concat(F.substring(new, F.lit(1), F.length(new) - 1), F.lit("0"))
    checked = F.concat(F.substring(new, F.lit(1), F.length(new) - 1), ((10 - _check_sum(body) % 10) % 10).cast("string"))
    number = F.when(_check_sum(digits) % 10 == 0, checked).otherwise(new)
    card = F.array_join(F.transform(F.split(core, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(number, F.length(F.regexp_replace(F.substring(core, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")

    country, account = F.substring(core, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.when(_mod97(core) == 1, F.concat(country, check, account)).otherwise(F.concat(country, F.substring(plain, F.lit(3), F.length(plain))))

    two = F.instr(core, " ") > 0

    def named(script):
        pick = lambda g: F.element_at(F.array(*map(F.lit, GIVEN[g, script])), _byte(F.col("_given"), F.lit(0)) % 16 + 1)
        parts = [F.element_at(F.array(*map(F.lit, SYLLABLES[script])), _byte(F.col("_family"), F.lit(i)) % 16 + 1) for i in range(4 + attempt)]
        return F.concat(F.when(two, F.concat(F.when((kind == "name_f") | ((kind == "name_u") & (_byte(F.col("_given"), F.lit(1)) % 2 == 0)), pick("f")).otherwise(pick("m")), F.lit(" "))).otherwise(""), F.initcap(F.concat(*parts)))

    name = F.when(core.rlike(r"\p{IsCyrillic}"), named("cyrillic")).otherwise(named("latin"))
    return F.when(kind == "mail", mail).when(kind == "domain", domain).when(kind == "ip", F.concat(ip, last)).when(kind == "card", F.concat(card, last)).when(kind == "iban", F.concat(iban, longer)).when(kind.startswith("name"), name).when(kind.isin("secret", "key"), F.concat(plain, letters)).otherwise(F.concat(plain, longer))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities: kind, core, distinct, and for mails domain (its surrogate). Adds surrogate, distinct within a kind and never
    an entity of the corpus."""
    if "domain" not in entities.columns:
        entities = entities.withColumn("domain", F.substring_index("core", "@", -1))
    open_, done = entities, None
    width = entities.sparkSession.sparkContext.defaultParallelism * 4
    real = entities.select(F.col("kind").alias("_k"), F.col("core").alias("_c"))
    for attempt in itertools.count():
        # digests once, before the exchange; few bytes but costly expressions, so dealt out by number and not by size
        drawn = open_.withColumns(draws(key, F.col("kind"), F.col("core"), attempt)).repartition(width, "kind", "core")
        drawn = drawn.select("kind", "core", surrogate(F.col("kind"), F.col("core"), attempt).alias("surrogate"))
        taken = real if done is None else real.union(done.select("kind", "surrogate"))
        free = drawn.join(taken.distinct(), (drawn["kind"] == F.col("_k")) & (drawn["surrogate"] == F.col("_c")), "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("core").alias("core")).select("kind", "core", "surrogate")
        done = staged(first if done is None else done.union(first), "surrogates")
        open_ = staged(open_.join(done.select("kind", "core"), ["kind", "core"], "left_anti"), "again")
        if open_.isEmpty():
            return done


def anonymise(docs: DataFrame, key: str = "surrogate-key", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All rows and columns of docs with the entities of the text replaced; count_col: also their number."""
    text = F.col(text_col).cast("string")
    marked = docs.select(F.sha2(text.cast("binary"), 256).alias("_text"), F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("_found")).where(F.size("_found") > 0)
    seen = staged(marked.distinct().select("_text", F.explode("_found").alias("_entity")), "entities")

    kind = kind_of(F.col("_entity"))
    parts = seen.groupBy("_entity").agg(F.count(F.lit(1)).alias("_n")).select("_entity", kind.alias("kind"), prefix_of(F.col("_entity"), kind).alias("_prefix"))
    parts = parts.withColumn("_raw", F.expr("substring(_entity, length(_prefix) + 1)")).withColumn("core", normal(F.col("_raw"), F.col("kind")))
    parts = staged(parts, "parts")
    domain = F.lower(F.substring_index("core", "@", -1))
    domains = surrogates(staged(parts.where("kind = 'mail'").select(F.lit("domain").alias("kind"), domain.alias("core")).distinct(), "domains"), key)
    cores = parts.select("kind", "core", F.when(F.col("kind") == "mail", domain).alias("_of")).distinct()
    cores = cores.join(domains.select(F.col("core").alias("_of"), F.col("surrogate").alias("domain")), "_of", "left").select("kind", "core", "domain")
    chosen = surrogates(staged(cores, "cores"), key)
    new = laid(F.col("_raw"), F.col("kind"), F.col("surrogate"))
    entry = lambda said, other, again: F.struct(said.alias("said"), other.alias("new"), F.lit(again).alias("again"))
    last = lambda c: F.substring_index(c, " ", -1)
    named = F.array(entry(F.col("_raw"), F.col("surrogate"), True), entry(last(F.col("_raw")), last(F.col("surrogate")), True))
    entries = F.concat(F.array(entry(F.col("_entity"), F.concat("_prefix", new), False)), F.when(F.col("kind").startswith("name"), named).otherwise(F.array().cast("array<struct<said:string,new:string,again:boolean>>")))
    swaps = parts.join(chosen, ["kind", "core"]).select(F.col("_entity").alias("_entity2"), entries.alias("_entries"))
    by_text = seen.join(swaps, seen["_entity"] == swaps["_entity2"]).groupBy("_text").agg(F.array_sort(F.flatten(F.collect_list("_entries"))).alias("_all"))
    once = F.filter("_all", lambda x, i: (i == 0) | (F.col("_all")[F.greatest(i - 1, F.lit(0))]["said"] != x["said"]))
    by_text = by_text.select(F.col("_text").alias("_text2"), once.alias("_all"))
    # longer names first, so that of a whole name no word is taken alone
    again = F.array_sort(F.transform(F.filter("_all", lambda x: x["again"]), lambda x: F.struct((-F.length(x["said"])).alias("n"), x["said"].alias("said"))))
    names = F.array_join(F.transform(again, lambda x: x["said"]), "|")
    pattern = F.when(names != "", F.concat(F.lit(PATTERN.removesuffix(")") + r"|(?=\p{Lu})(?:"), names, F.lit(f"){_MENTION_END})"))).otherwise(F.lit(PATTERN))
    by_text = by_text.select("_text2", F.map_from_entries(F.transform("_all", lambda x: F.struct(x["said"], x["new"]))).alias("_swap"), pattern.alias("_pattern"))

    has = F.coalesce(text.rlike(PATTERN), F.lit(False))
    dirty = docs.where(has).select(F.struct(*docs.columns).alias("_row"), text.alias("_old"), F.sha2(text.cast("binary"), 256).alias("_text"))  # no column of docs beside ours
    dirty = dirty.join(by_text, F.col("_text") == F.col("_text2"))
    old = F.col("_old")
    found = F.regexp_extract_all(old, F.col("_pattern"), F.lit(0))
    new = F.array_join(F.zip_with(F.split(old, F.col("_pattern"), -1), found, lambda a, b: F.concat(a, F.coalesce(F.element_at(F.col("_swap"), b), F.lit("")))), "")
    dirty = dirty.withColumn("_changed", new)
    columns = [c for c in docs.columns if c != count_col]
    kept = [F.col("_changed").alias(c) if c == text_col else F.length("_changed").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in columns]
    count = [F.size(found).cast("long").alias(count_col)] if count_col else []
    none = [F.lit(0).cast("long").alias(count_col)] if count_col else []
    return docs.where(~has).select(*columns, *none).union(dirty.select(*kept, *count))
