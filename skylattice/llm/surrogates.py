"""Surrogates for personal data, in DataFrame and SQL functions only.

Detected entities are e-mail addresses, IPv4 addresses, payment-card and telephone numbers, and names after titles, whose given
names and surnames are then also replaced wherever the same text mentions them without a title. Each is
one or more units (type, normal form); a unit's surrogate is a keyed hash of both, of the same type and format: cards keep
their first digit and a valid check digit, telephone numbers their country code and layout, addresses their case and
punctuation, names their title, gender and script. Equal units get equal surrogates wherever they stand.

All units of the corpus are checked: where surrogates coincide, or a surrogate is the normal form of a unit that occurs, all
but one of those concerned move to their next attempt until nothing coincides. Texts are rewritten in place; only units past
attempt 0 are looked up, through a table of the texts that hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.materialise import materialise

FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Señorita|Госпожа|Κυρία"
MALE = "Mr|Sir|Herr|Monsieur|Señor|Господин|Κύριος"
TITLES = f"{FEMALE}|{MALE}|Dr|Doctor|Doktor|Docteur|Prof|Professor|Professeur|Mx|Rev|Доктор|Профессор"
NAME = r"\p{Lu}\p{L}*+(?:['-](?!s(?!\p{L}))\p{L}++)*+"
#: The words of a text and what is between them, for mentions of its names.
WORDS = r"\p{L}++(?:['-](?!s(?!\p{L}))\p{L}++)*+|[^\p{L}]++"
PATTERN = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])",
    r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9]|\.[0-9])",
    r"(?<![0-9.,:/-])0[0-9]{1,4}[ /-][0-9]{5,8}(?![0-9])",
    rf"(?<!\p{{L}})(?:(?:{TITLES})\.? )++{NAME}(?: {NAME})?",
])
#: What a text with an entity has; cheap to look for.
HINT = rf"@|[0-9][0-9.() /-]{{5}}|(?:{TITLES})"
#: From this attempt on surrogates also grow in length, so that short formats cannot run out.
GROWING = 4
_SYLLABLES = {"cyrillic": "ба ве ги до жу за ки ло ма не ро са ти фо ха ше", "greek": "βα γε δι ζο θυ κα λε μι νο πυ ρα σε τι φο χα ψε", "latin": "ba ce di fo gu ha je ki lo mu na pe ri so tu ve"}


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _draw(key: str, unit: str, attempt: str, i: str) -> str:
    """A whole number from the keyed hash of a unit, for place `i`."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, {unit}.type, {unit}.norm, cast({attempt} AS string), cast({i} AS string)), 256), 1, 12), 16, 10) AS bigint)"


def _titles(e: str) -> str:
    """SQL of the titles before a name, with the blanks after them."""
    return f"regexp_extract({e}, '^(?:(?:{TITLES})[.]? )+', 0)"


def _units(e: str) -> str:
    """SQL array of the units of an entity."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    country = f"regexp_extract({e}, '^[+]([0-9]+)(?=[ .(-])', 1)"
    one = lambda kind, norm: f"array(named_struct('type', {kind}, 'norm', {norm}))"
    gender = f"CASE WHEN {e} rlike '(^| )({FEMALE})[. ]' THEN 'given_f' WHEN {e} rlike '(^| )({MALE})[. ]' THEN 'given_m' ELSE 'given_n' END"
    words = f"split(substr({e}, length({_titles(e)}) + 1), ' ')"
    return f"""CASE WHEN contains({e}, '@') THEN {one("'email'", f"lower({e})")}
        WHEN {e} rlike '^[^0-9+(]' THEN CASE WHEN size({words}) > 1
            THEN array(named_struct('type', {gender}, 'norm', lower({words}[0])), named_struct('type', 'surname', 'norm', lower({words}[1])))
            ELSE {one("'surname'", f"lower({words}[0])")} END
        WHEN {e} rlike '^[0-9]+([.][0-9]+){{3}}$' THEN {one("'ip'", e)}
        WHEN {e} rlike '^[0-9]{{4}}' AND length({digits}) >= 13 THEN {one("'card'", digits)}
        ELSE {one("'phone'", f"concat({country}, '/', substr({digits}, length({country}) + 1))")} END"""


def _normal_surrogate(key: str, u: str, a: str) -> str:
    """SQL of the surrogate of unit `u` at attempt `a`, in the normal form of its type."""
    draw = lambda i: _draw(key, u, a, i)
    digit = f"cast(pmod({draw('i')}, 10) AS string)"
    grown = f"CASE WHEN {a} >= {GROWING} THEN substr(sha2(concat_ws('|', {_text(key)}, {u}.type, {u}.norm, cast({a} AS string)), 256), 1, 8) ELSE '' END"
    local, domain = f"split({u}.norm, '@')[0]", f"split({u}.norm, '@')[1]"
    char = f"""CASE WHEN substr({local}, i, 1) rlike '[a-z]' THEN chr(97 + pmod({draw('i')}, 26)) WHEN substr({local}, i, 1) rlike '[0-9]' THEN {digit} ELSE substr({local}, i, 1) END"""
    host = f"""array_join(transform(sequence(1, 6), i -> chr(97 + pmod(cast(conv(substr(sha2(concat_ws('|', {_text(key)}, 'domain', {domain}, cast(i AS string)), 256), 1, 12), 16, 10) AS bigint), 26))), '')"""
    email = f"concat(array_join(transform(sequence(1, length({local})), i -> {char}), ''), {grown}, '@', {host}, '.example')"
    rest = f"substring_index({u}.norm, '/', -1)"
    phone = f"concat(substring_index({u}.norm, '/', 1), '/', array_join(transform(sequence(1, length({rest})), i -> {digit}), ''))"
    body = f"transform(sequence(1, length({u}.norm) - 1), i -> CASE WHEN i = 1 THEN cast(substr({u}.norm, 1, 1) AS bigint) ELSE pmod({draw('i')}, 10) END)"
    odd = f"pmod(length({u}.norm) - i - 1, 2) = 1"
    total = f"aggregate(transform({body}, (x, i) -> CASE WHEN {odd} THEN CASE WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END ELSE x END), 0L, (s, x) -> s + x)"
    card = f"concat(array_join(transform({body}, x -> cast(x AS string)), ''), cast(pmod(10 - pmod({total}, 10), 10) AS string))"
    ip = f"array_join(transform(sequence(1, 4), i -> cast(pmod({draw('i')}, 254) + 1 AS string)), '.')"

    def name(script: str) -> str:
        syllables = "split(" + _text(_SYLLABLES[script]) + ", ' ')"
        ends = {"cyrillic": ("на", "н", "в"), "greek": ("να", "ν", "ς"), "latin": ("na", "n", "s")}[script]
        end = f"CASE {u}.type WHEN 'given_f' THEN '{ends[0]}' WHEN 'given_m' THEN '{ends[1]}' ELSE '{ends[2]}' END"
        return f"concat(array_join(transform(sequence(1, 3 + greatest(0, {a} - {GROWING - 1})), i -> element_at({syllables}, cast(pmod({draw('i')}, 16) + 1 AS int))), ''), {end})"

    names = f"CASE WHEN {u}.norm rlike '\\\\p{{IsCyrillic}}' THEN {name('cyrillic')} WHEN {u}.norm rlike '\\\\p{{IsGreek}}' THEN {name('greek')} ELSE {name('latin')} END"
    return f"CASE {u}.type WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} ELSE {names} END"


def _cased(word: str, new: str) -> str:
    return f"CASE WHEN length({word}) > 1 AND {word} = upper({word}) THEN upper({new}) ELSE initcap({new}) END"


def _formatted(e: str, s: str) -> str:
    """SQL of the surrogates `s` (array, one for each unit) in the format of the entity `e`."""
    cased = f"""array_join(transform(sequence(1, length({s}[0])), i -> CASE WHEN i <= length(substring_index({e}, '@', 1)) AND substr({e}, i, 1) rlike '[A-Z]' THEN upper(substr({s}[0], i, 1)) ELSE substr({s}[0], i, 1) END), '')"""
    digits = f"replace({s}[0], '/', '')"
    laid = f"""array_join(transform(sequence(1, length({e})), i -> CASE WHEN substr({e}, i, 1) rlike '[0-9]' THEN substr({digits}, length(regexp_replace(substr({e}, 1, i), '[^0-9]', '')), 1) ELSE substr({e}, i, 1) END), '')"""
    words = f"split(substr({e}, length({_titles(e)}) + 1), ' ')"
    named = f"concat({_titles(e)}, {_cased(f'{words}[0]', f'{s}[0]')}, CASE WHEN size({s}) > 1 THEN concat(' ', {_cased(f'{words}[1]', f'{s}[1]')}) ELSE '' END)"
    return f"CASE WHEN contains({e}, '@') THEN {cased} WHEN {e} rlike '^[^0-9+(]' THEN {named} WHEN {e} rlike '^[0-9]+([.][0-9]+){{3}}$' THEN {s}[0] ELSE {laid} END"


def _with_entities(docs: DataFrame) -> DataFrame:
    """doc_id, text, tkey and the array of entities of each text."""
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("tkey", F.xxhash64("text")).withColumn("entities", F.coalesce(found, F.array().cast("array<string>")))


def unit_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """type, norm, attempt, surrogate of every unit of the corpus, without coincidences."""
    units = _with_entities(docs).where("size(entities) > 0").select(F.explode("entities").alias("e")).select(F.explode(F.expr(_units("e"))).alias("u"))
    units = units.groupBy("u.type", "u.norm").agg(F.lit(0).alias("attempt"))
    drawn = F.expr(_normal_surrogate(key, "named_struct('type', type, 'norm', norm)", "attempt"))
    table = materialise(units.withColumn("surrogate", drawn))
    while True:
        taken = table.groupBy("type", "surrogate").agg(F.min("norm").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
        real = table.select("type", F.col("norm").alias("surrogate"), F.lit(None).cast("string").alias("holder"))
        real = real.join(table.select("type", "surrogate"), ["type", "surrogate"], "left_semi")
        holders = taken.unionByName(real).groupBy("type", "surrogate").agg(F.max(F.isnull("holder")).alias("real"), F.min("holder").alias("holder"))
        moved = table.join(holders, ["type", "surrogate"]).where("real OR norm <> holder").select("type", "norm", (F.col("attempt") + 1).alias("attempt"))
        moved = materialise(moved)
        if moved.isEmpty():
            return table
        rest = table.join(moved.select("type", "norm"), ["type", "norm"], "left_anti")
        table = materialise(rest.unionByName(moved.withColumn("surrogate", drawn)))


def with_surrogates(docs: DataFrame, key: str = "change-this-key") -> DataFrame:
    """One row per row of `docs`: doc_id, text with surrogates, n_entities.

    A text's names are also replaced where they stand without a title; only detected entities are counted. Null texts stay null and have no entities. Rows with equal or null ids are rewritten one by one, equal texts alike. Other
    columns are ignored. The same key gives the same surrogates as long as no attempt changes.
    """
    table = unit_surrogates(docs, key)
    rows = _with_entities(docs)
    late = materialise(table.where("attempt > 0").select("type", "norm", "attempt"))
    if late.isEmpty():
        rows = rows.withColumn("late", F.lit(None).cast("map<string,int>"))
    else:
        held = rows.where("size(entities) > 0").select("doc_id", "tkey", F.explode("entities").alias("e")).select("doc_id", "tkey", F.explode(F.expr(_units("e"))).alias("u"))
        held = held.select("doc_id", "tkey", "u.type", "u.norm").distinct().join(late, ["type", "norm"])
        # a text's own units: bounded by its length
        held = held.groupBy(F.col("doc_id").alias("hid"), F.col("tkey").alias("hkey")).agg(F.expr("map_from_entries(collect_set(struct(concat(type, ':', norm), attempt)))").alias("late"))
        rows = rows.join(materialise(held), F.expr("tkey = hkey AND doc_id <=> hid"), "left")
    surrogates = f"transform(x.u, u -> {_normal_surrogate(key, 'u', 'coalesce(late[concat(u.type, \":\", u.norm)], 0)')})".replace('":"', "':'")
    drawn = rows.withColumn("drawn", F.expr(f"transform(transform(entities, e -> named_struct('e', e, 'u', {_units('e')})), x -> named_struct('e', x.e, 'u', x.u, 's', {surrogates}))"))
    # the names of the text, for mentions without a title; a name that is given and surname keeps the first of both
    drawn = drawn.withColumn("names", F.expr("filter(flatten(transform(drawn, x -> arrays_zip(x.u, x.s))), z -> z.u.type IN ('surname', 'given_f', 'given_m', 'given_n'))"))
    formed = drawn.withColumn("made", F.expr(f"transform(drawn, x -> {_formatted('x.e', 'x.s')})"))
    formed = formed.withColumn("own", F.expr("map_from_arrays(array_distinct(transform(names, z -> z.u.norm)), transform(array_distinct(transform(names, z -> z.u.norm)), n -> filter(names, z -> z.u.norm = n)[0].s))"))
    pieces = formed.withColumn("pieces", F.when(F.expr("size(entities) > 0"), F.split("text", PATTERN, -1)))
    mention = f"array_join(transform(regexp_extract_all(p, {_text(WORDS)}, 0), w -> CASE WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) AND own[lower(w)] IS NOT NULL THEN {_cased('w', 'own[lower(w)]')} ELSE w END), '')"
    piece = f"CASE WHEN size(names) > 0 THEN {mention} ELSE p END"
    text = F.when(F.expr("size(entities) = 0"), F.col("text")).otherwise(F.expr(f"array_join(transform(pieces, (p, k) -> concat({piece}, coalesce(get(made, k), ''))), '')"))
    return pieces.select("doc_id", text.alias("text"), F.size("entities").cast("long").alias("n_entities"))
