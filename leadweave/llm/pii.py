r"""Surrogates for personal data: keyed, of the same type and format, distinct, and the same wherever an entity recurs.

Entities are e-mail addresses, IPv4 addresses, phone numbers, card-like numbers of 13 to 19 digits,
names behind an honorific (as listed, or in capitals), and first and last names of these people where
the same text has them without one, with capital initials or in capitals; a last
name or a first name alone stays, since many are ordinary words. A surrogate is made from SHA-256 of a secret key, the type and the
normalised entity, so an entity gets the same one in every document. Digits keep their number and
punctuation, phone numbers their country code, card numbers a right check digit if they had one; a name keeps its honorific, letter case and script, and
its first name the gender that the honorific says (without one, that of the first person of the name in the text); last names are replaced on their own, so `Mr. A B`
and `Mr. B` stay one person. First names repeat among people and are distinct among those of one last
name; where the list of names has no free one, syllables are added. All distinct entities are checked: of entities whose
surrogates are equal, and of those whose surrogate is itself an entity, all but one (or all) get
another attempt, until none is left. Few entities need a second attempt; only texts that name
one of those meet a table. DataFrame functions only.

A match is worked out in steps, each a transform() over structs of what the step before found, and names
and syllables come from one literal table each; so no expression is repeated and the plan stays small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.tables import fresh, written

# Honorifics by gender and the names that surrogates are made of.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Mister", "Господин", "Г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Г-жа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
ABBREVIATED = ("Mr", "Mrs", "Ms", "Sr", "Sra", "Mme", "Dr", "Prof")  # in capitals (MS, SR) a title only with its point
ALSO_A_WORD = ("Miss",)  # in capitals no title
FIRST = {
    ("latin", "m"): ("Adrian", "Bruno", "Conrad", "Desmond", "Edgar", "Felix", "Gregor", "Hector", "Ivan", "Julius", "Leon", "Marius", "Nolan", "Oscar", "Quentin", "Rupert"),
    ("latin", "f"): ("Amelia", "Beatrix", "Clara", "Daphne", "Elena", "Fiona", "Greta", "Helena", "Irene", "Julia", "Lydia", "Marina", "Nadia", "Olivia", "Rosalie", "Sabina"),
    ("latin", "n"): ("Alexis", "Charlie", "Dominique", "Jordan", "Kim", "Morgan", "Robin", "Sasha"),
    ("cyrillic", "m"): ("Алексей", "Борис", "Виктор", "Григорий", "Дмитрий", "Егор", "Игорь", "Максим"),
    ("cyrillic", "f"): ("Алина", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Марина", "Ольга"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Шура"),
    ("greek", "m"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
    ("greek", "n"): ("Αλέξης", "Χρύση"),
}
SYLLABLES = {
    "latin": ("bar", "cal", "dor", "fen", "gar", "hol", "jas", "kel", "lan", "mor", "nar", "pel", "ros", "sel", "tor", "van"),
    "cyrillic": ("бар", "вел", "гор", "дам", "жар", "зим", "кал", "лан", "мир", "нор", "пал", "рос", "сел", "тар", "фед", "чер"),
    "greek": ("βαρ", "γαλ", "δορ", "ζαν", "θεο", "καλ", "λαμ", "μαν", "νικ", "παλ", "ραφ", "σαβ", "ταμ", "φιλ", "χαρ", "ψαρ"),
}

# Possessive: what repeats a group would else recurse once a label.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
HONORIFIC = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + ")"
_CAPITALS = [h.upper() + (r"\." if h in ABBREVIATED else r"\.?") for h in MALE + FEMALE + NEUTRAL if h not in ALSO_A_WORD]
TITLE = rf"(?:{HONORIFIC}\.?|{'|'.join(_CAPITALS)})\x20"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE}\p{{Lu}}[\p{{L}}'-]+(?:\x20\p{{Lu}}[\p{{L}}'-]+)?"
ENTITY = f"{EMAIL}|{IP}|{PHONE}|{CARD}|{NAME}"
ROUNDS = 40
BROADCAST_ROWS = 100_000


_GENDERS, _SCRIPTS = "mfn", tuple(SYLLABLES)


def _table(rows: list[tuple[str, ...]]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))



def _steps(items: Column, *steps: Callable[[Column], dict[str, Column]]) -> Column:
    """array<struct>: each step makes the next structs from the ones before."""
    for step in steps:
        items = F.transform(items, lambda x: F.struct(*(c.alias(n) for n, c in step(x).items())))  # noqa: B023
    return items


def _both(honorifics: tuple[str, ...]) -> tuple[str, ...]:
    return honorifics + tuple(h.upper() for h in honorifics)


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def matches(found: Column, people: Column | None = None) -> Column:
    """Of each match: raw, title, head (country code), kind, names, and its parts as array<struct<type, norm>>.

    A name is made of its names (the first one with the last one), anything else of itself. `people`
    (array<struct<name, gender>>, see known_people) tells the gender of names without a title.
    """

    def seen(raw: Column) -> dict[str, Column]:
        return {
            "raw": raw,
            "title": F.regexp_extract(raw, rf"^{TITLE}", 0),
            "head": F.regexp_extract(raw, r"^\+\d{1,3}(?=[ (.-])", 0),
            "digits": F.regexp_replace(raw, r"\D", ""),
        }

    def told(x: Column) -> dict[str, Column]:
        bare = F.regexp_replace(x["title"], r"\.?\x20$", "")
        card = (F.length(x["digits"]) >= 13) & ~x["raw"].rlike(r"^[+(]")
        titled = F.when(bare.isin(*_both(MALE)), "m").when(bare.isin(*_both(FEMALE)), "f").otherwise("n")
        same = None if people is None else F.filter(people, lambda p: p["name"] == F.lower(x["raw"]))
        return {
            **{c: x[c] for c in ("raw", "title", "head", "digits")},
            "kind": F.when(x["raw"].contains("@"), "email").when(x["raw"].rlike(r"^\p{L}"), "name").when(x["raw"].rlike(f"^(?:{IP})$"), "ip").when(card, "card").otherwise("phone"),
            "names": F.split(F.substr(x["raw"], F.length(x["title"]) + 1), " "),
            "gender": titled if same is None else F.when(x["title"] != "", titled).otherwise(F.coalesce(F.get(same, F.lit(0))["gender"], F.lit("n"))),
        }

    def made_of(x: Column) -> dict[str, Column]:
        first, last = F.element_at(x["names"], 1), F.element_at(x["names"], -1)
        of = lambda kind, norm: F.struct(kind.alias("type"), norm.alias("norm"))
        as_last = of(F.concat(F.lit("last."), _script(last)), F.lower(last))
        as_first = of(F.concat(F.lit("first."), x["gender"], F.lit("."), _script(first)), F.concat(F.lower(first), F.lit(" "), F.lower(last)))
        number = F.substr(x["digits"], F.greatest(F.lit(1), F.length(x["head"])))  # the head has a sign before its digits
        itself = of(x["kind"], F.when(x["kind"] == "email", F.lower(x["raw"])).when(x["kind"] == "ip", x["raw"]).when(x["kind"] == "card", x["digits"]).otherwise(number))
        parts = F.when(x["kind"] != "name", F.array(itself)).when(F.size(x["names"]) > 1, F.array(as_first, as_last)).otherwise(F.array(as_last))
        return {c: x[c] for c in ("raw", "title", "head", "kind", "names")} | {"parts": parts}

    return _steps(found, seen, told, made_of)


def known_people(found: Column) -> Column:
    """array<struct<name, gender>>: the first and last names behind an honorific in lower case, once for each gender, first ones first."""
    named = F.filter(matches(found), lambda x: (x["kind"] == "name") & (F.size(x["names"]) > 1))
    of = lambda x: F.struct(F.lower(F.array_join(x["names"], " ")).alias("name"), F.split_part(F.get(x["parts"], F.lit(0))["type"], F.lit("."), F.lit(2)).alias("gender"))
    return F.array_distinct(F.transform(named, of))


def entity_pattern(people: Column) -> Column:
    """ENTITY, or a known person's first and last name without an honorific. Names hold letters, ' and - only, so none needs escapes."""
    word = lambda w: F.concat(F.lit(r"(?=\p{Lu})(?iu:"), w, F.lit(")"))
    forms = F.transform(F.array_distinct(F.transform(people, lambda p: p["name"])), lambda n: F.array_join(F.transform(F.split(n, " "), word), " "))
    # The start of an e-mail address is no name.
    return F.concat(F.lit(rf"{ENTITY}|(?<![\p{{L}}\p{{N}}'-])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}'-]|[\p{L}\p{N}._%+-]*+@)"))


def _own(kind: Column, norm: Column) -> Column:
    """The norm without the last name that a first name's ends in."""
    return F.when(kind.startswith("first."), F.substring_index(norm, " ", 1)).otherwise(norm)


def _luhn(digits: Column) -> Column:
    """The sum that a card number's check digit makes divisible by ten."""
    twice = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(twice, d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """Of an entity: digits for numbers, lower-case text for the others."""

    def given(x: Column) -> dict[str, Column]:
        # A first name's norm ends in the last name, which only tells whom it has to differ from.
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), x["type"], _own(x["type"], x["norm"]), x["attempt"].cast("string")), 256)
        script = F.substring_index(x["type"], ".", -1)
        return {
            "type": x["type"], "norm": x["norm"], "digest": digest, "digits": F.translate(digest, "abcdef", "037159"),
            "script": F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, _SCRIPTS)), script).cast("int")),
            "gender": F.greatest(F.lit(1), F.instr(F.lit(_GENDERS), F.split_part(x["type"], F.lit("."), F.lit(2)))),
            # Places of the syllables in the digest, 4 bits apart. Each attempt at a first name has more, so that they can't run out.
            "at": F.when(x["type"] == "email", F.sequence(F.lit(1), F.lit(4))).when(x["type"].startswith("last."), F.sequence(F.lit(1), F.lit(5)))
            .when(x["type"].startswith("first."), F.slice(F.array(*map(F.lit, (20, 21, 30, 31, 32, 33))), F.lit(1), F.when(x["attempt"] > 1, 6).when(x["attempt"] > 0, 2).otherwise(0))),
        }

    number = lambda x, at: F.conv(F.substr(x["digest"], at, F.lit(7)), 16, 10).cast("bigint")

    def words(x: Column) -> dict[str, Column]:
        syllables = F.element_at(_table([SYLLABLES[s] for s in _SCRIPTS]), x["script"])
        firsts = F.element_at(_table([FIRST[s, g] for s in _SCRIPTS for g in _GENDERS]), (x["script"] - 1) * len(_GENDERS) + x["gender"])
        size = F.length(x["norm"])
        plain = F.substr(x["digits"], F.lit(1), size)
        body = F.substr(x["digits"], F.lit(1), size - 1)
        return {
            **{c: x[c] for c in ("type", "digest", "digits")},
            "word": F.array_join(F.transform(x["at"], lambda at: F.element_at(syllables, (number(x, at) % 16 + 1).cast("int"))), ""),
            "first": F.lower(F.element_at(firsts, (number(x, F.lit(1)) % F.size(firsts) + 1).cast("int"))),
            "number": F.when((x["type"] == "card") & (_luhn(x["norm"]) % 10 == 0), F.concat(body, F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))).otherwise(plain),
        }

    def out(x: Column) -> dict[str, Column]:
        n = lambda at: number(x, F.lit(at))
        # Digits keep addresses apart.
        email = F.concat(x["word"], F.lit("."), F.substr(x["digits"], F.lit(20), F.lit(8)), F.lit("@mail"), (n(40) % 10).cast("string"), F.lit(".example.org"))
        ip = F.concat_ws(".", *(c.cast("string") for c in (1 + n(1) % 223, n(9) % 256, n(17) % 256, n(25) % 256)))
        first = F.concat(x["first"], x["word"])
        return {"out": F.when(x["type"] == "email", email).when(x["type"] == "ip", ip).when(x["type"].isin("phone", "card"), x["number"]).when(x["type"].startswith("last."), x["word"]).otherwise(first)}

    made = _steps(F.array(F.struct(kind.alias("type"), norm.alias("norm"), attempt.alias("attempt"))), given, words, out)
    return F.element_at(made, 1)["out"]


def _shaped(raw: Column, new: Column) -> Column:
    """The surrogate in the letter case of what it stands for."""
    return F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(new)).otherwise(F.initcap(new))


def _rewritten(found: Column, people: Column, key: str, attempts: Column | None) -> Column:
    """array<string>: each match with its parts replaced, in its own format."""

    def new(part: Column) -> Column:
        attempt = F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat_ws("\x1f", part["type"], part["norm"])), F.lit(0))
        return surrogate(part["type"], part["norm"], attempt, key)

    def put(x: Column) -> Column:
        first, last = F.element_at(x["made"], 1), F.element_at(x["made"], -1)
        gaps = F.split(F.substr(x["raw"], F.length(x["head"]) + 1), r"\d", -1)
        digits = F.concat(F.split(last, "(?!^)(?!$)"), F.array(F.lit("")))
        number = F.concat(x["head"], F.array_join(F.zip_with(gaps, digits, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
        given = F.when(F.size(x["names"]) > 1, F.concat(_shaped(F.element_at(x["names"], 1), first), F.lit(" "))).otherwise("")
        person = F.concat(x["title"], given, _shaped(F.element_at(x["names"], -1), last))
        return F.when(x["kind"] == "name", person).when(x["kind"].isin("phone", "card"), number).otherwise(last)

    made = _steps(matches(found, people), lambda x: {c: x[c] for c in ("raw", "title", "head", "kind", "names")} | {"made": F.transform(x["parts"], new)})
    return F.transform(made, put)


def attempts_of(entities: DataFrame, key: str) -> DataFrame:
    """(type, norm, attempt) of the distinct entities whose first surrogate won't do."""
    # Surrogates are distinct within a type; those of first names within the last name, of any gender.
    within = F.when(F.col("type").startswith("first."), F.concat(F.lit("first "), F.substring_index("norm", " ", -1))).otherwise(F.col("type"))
    now = written(entities.withColumns({"attempt": F.lit(0), "within": within}), "entities")
    own = now.select("within", _own(F.col("type"), F.col("norm")).alias("new")).distinct()
    for _ in range(ROUNDS):
        made = now.withColumn("new", surrogate(F.col("type"), F.col("norm"), F.col("attempt"), key))
        keep = made.groupBy("within", "new").agg(F.min(F.struct("attempt", "norm", "type")).alias("first"), F.count("*").alias("n"))
        # Of equals the one that has tried least stays; no one may take a real entity's form.
        twice = keep.where("n > 1").select("within", "new", F.struct("first.norm", "first.type").alias("stays"))
        real = made.select("within", "new").distinct().join(own, ["within", "new"], "left_semi").withColumn("stays", F.lit(None).cast(twice.schema["stays"].dataType))
        bad = written(made.join(twice.unionByName(real).groupBy("within", "new").agg(F.min(F.when(F.col("stays").isNotNull(), F.col("stays"))).alias("stays"), F.max(F.col("stays").isNull()).alias("real")), ["within", "new"]).where("real or struct(norm, type) <> stays").select("type", "norm").distinct(), "again")
        if bad.isEmpty():
            break
        now = written(now.join(bad.withColumn("more", F.lit(1)), ["type", "norm"], "left").select("type", "norm", "within", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities")
    else:
        raise RuntimeError("surrogates still collide: the space of a type is too small for its entities")
    return now.where("attempt > 0").drop("within")


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """df with the entities in text_col replaced; `count_col` adds how many.

    Null texts stay null and empty ones empty; repeated rows get the same text; a text has no limit and an
    empty table gives no rows. The other columns of df come back as they are, in order, whatever their
    names. Of entities that would get one surrogate the one that sorts first keeps it. Texts that name an
    entity with a further attempt are told by their 64-bit hash; if two had the same, each would be
    given the attempts of both, which changes nothing, since attempts are looked up by entity.
    """
    text, row, tried, who = F.col(f"`{text_col}`"), fresh(df, "row"), fresh(df, "attempts"), fresh(df, "people")
    has = F.coalesce(text.rlike(ENTITY), F.lit(False))
    found = F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1))
    # Distinct per text first, so that one that repeats an entity shuffles it once.
    parts = F.array_distinct(F.flatten(F.transform(matches(found), lambda x: x["parts"])))
    named = df.where(has).select(F.xxhash64(text).alias("row"), F.explode(parts).alias("e")).select("row", "e.*")
    again = written(attempts_of(named.select("type", "norm").distinct(), key), "attempts")
    count = again.count()
    base, attempts = df, None
    if count:
        per_row = (
            named.join(F.broadcast(again) if count <= BROADCAST_ROWS else again, ["type", "norm"]).distinct()
            .groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "type", "norm"), "attempt"))).alias(tried))
        )
        per_row = written(per_row, "attempts")
        if per_row.count() <= BROADCAST_ROWS:
            per_row = F.broadcast(per_row)
        base = df.withColumn(row, F.xxhash64(text)).join(per_row, row, "left")
        attempts = F.coalesce(F.col(tried), F.expr("cast(map() as map<string,int>)"))
    # A column of its own, as it is used more than once. People without a title add no entity, so `named` has all.
    base = base.withColumn(who, F.when(has, known_people(found)))
    people = F.col(f"`{who}`")
    every = F.when(F.size(people) > 0, F.regexp_extract_all(text, F.concat(F.lit("("), entity_pattern(people), F.lit(")")), F.lit(1))).otherwise(found)
    gaps = F.when(F.size(people) > 0, F.split(text, entity_pattern(people), -1)).otherwise(F.split(text, ENTITY, -1))
    new = F.concat(_rewritten(every, people, key, attempts), F.array(F.lit("")))
    replaced = F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, b)), "")
    out = [F.when(has, replaced).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if count_col:
        out.append(F.when(has, F.size(every)).otherwise(0).cast("bigint").alias(count_col))
    return base.select(out)
