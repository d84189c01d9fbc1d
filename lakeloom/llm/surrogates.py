"""Personal data replaced by keyed surrogates, in DataFrame and SQL operations only.

Entities are found by one pattern; what a match is follows from its own text.
Names are those behind a title, and listed given names with the name that
follows; a text's names are replaced wherever they stand in that text, titled or
not, in scripts with and without capitals. Initials, particles ("van", "de la")
and names that a text never gives with a title or a listed given name stay.

An entity's surrogate is a function of key, type and canonical form alone: equal
entities get equal surrogates everywhere, without a join. Numbers go through a
keyed Feistel network, a bijection on numbers of one length. A given name is
male or female by its list, else by the title before it and a family name; a
listed one becomes its successor in a keyed order of its list, and where all of
those are taken, as with an unlisted one, keyed letters with an ending of that
gender. Other names and mail addresses get keyed letters of the same script and
length. Case, separators and digit groups are those of the match; card numbers
with a valid check digit keep one. The key reaches plans as a subquery's result,
so their text doesn't show it.

The distinct entities are checked: where two share a surrogate, or one's
surrogate is another's real value, all but one draw again, until all differ: of
two the smaller canonical form keeps it. Names of all types share one check.
Only entities that drew again are joined to the documents that name them.

Null text stays null; texts without entities stay as they are; repeated rows
get the same text; an empty table gives an empty result; other columns of the
table are left behind, whatever their names; texts of any length are searched
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Given names by gender, and titles before names.
MALE = ("adam", "carlos", "david", "felipe", "hans", "henri", "ivan", "james", "jean", "john", "jorge", "juan", "karl", "louis", "luis", "marc", "mark", "michael", "miguel", "otto", "paul", "peter", "pierre", "robert", "thomas", "william")
FEMALE = ("alice", "ana", "anna", "camille", "carmen", "claire", "clara", "elena", "emma", "eva", "greta", "heidi", "ingrid", "isabel", "jane", "julia", "laura", "lucia", "marie", "mary", "monika", "nina", "petra", "sarah", "sofia", "susan")
MEN = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "السيد", "श्री")
WOMEN = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа", "السيدة", "श्रीमती")
TITLES = (*MEN, *WOMEN, "Dr", "Prof")
# Letters that surrogates are made of, by script.
SCRIPTS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Han": "安白成大方高国海和华江金兰林明南平青山石天文小新雪阳云正",
    "Arabic": "ابتجحدرزسشصطعفقكلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "कगचजटडतदनपबमयरलवशसह",
    "Hangul": "가나다라마바사아자차하강경김동민수영",
    "Hiragana": "あいうえおかきくさしたなはまやり",
    "Katakana": "アイウエオカキクサシタナハマヤリ",
    "Thai": "กขคงจชดตนบปพมยรลวสห",
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EDGE, _STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# A name's word, in Unicode's capitals or in a script without them; hyphens and apostrophes join parts, a final 's stays out.
_WORD = r"(?:\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]\p{L}{2}))|\p{Lo}[\p{L}\p{M}]*+)(?:['’-]\p{L}[\p{L}\p{M}]++)*+"
# Each alternative begins behind an edge or is possessive, so that a long word is read once.
PATTERN = "|".join(
    [
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
        rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
        rf"{_EDGE}\d{{4}}([ -]?)\d{{4}}\1\d{{4}}\1\d{{4}}{_STOP}",
        r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{3,4}" + _STOP,
        r"(?<![\p{L}\p{N}(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}" + _STOP,
        rf"(?<![\p{{L}}\p{{N}}.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\p{{L}}\p{{N}}]|[.-]\d)",
        r"(?<![\p{L}\p{N}.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
        rf"{_EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_STOP}",
    ]
)
#: The same, and every word that may be a name: which of them are is known by the text's names.
PATTERN_NAMES = rf"{PATTERN}|(?<![\p{{L}}\p{{M}}\p{{N}}]){_WORD}"


def _before(words: tuple[str, ...], stop: str) -> str:
    """One of the words at an edge; the first letters are looked at before the alternatives are."""
    return rf"(?=[{''.join(sorted({w[0] for w in words}))}])(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(words)}){stop}"


_TITLED = _before(TITLES, r"\.? ")
_LISTED = _before(tuple(n.capitalize() for n in (*MALE, *FEMALE)), rf"(?= {_WORD})")
#: What a text with names has, and what every text with entities has one of.
NAME_HINT = f"{_TITLED}|{_LISTED}"
HINT = f"[@0-9]|{NAME_HINT}"
#: Draws of a listed given name within its list.
LIST_DRAWS = 3
#: Draws after which a name or address grows by a letter.
GROW = 8
MAX_DRAWS = 200
#: The column that holds the key.
KEY = "__key"


def _sql(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(m: str) -> str:
    """SQL for the type of a match in a row with names, men and women; null of a word that is no name."""
    lower = f"lower({m})"
    return f"""CASE WHEN contains({m}, '@') THEN 'email'
      WHEN {m} RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' THEN 'ip'
      WHEN {m} RLIKE '^[A-Z][A-Z][0-9]' THEN 'iban'
      WHEN {m} RLIKE '^[\\\\p{{L}}]' THEN CASE
        WHEN NOT array_contains(names, {lower}) THEN NULL
        WHEN {lower} IN ({", ".join(map(_sql, MALE))}) THEN 'male'
        WHEN {lower} IN ({", ".join(map(_sql, FEMALE))}) THEN 'female'
        WHEN array_contains(men, {lower}) = array_contains(women, {lower}) THEN 'name'
        WHEN array_contains(men, {lower}) THEN 'male' ELSE 'female' END
      WHEN {m} RLIKE '^[+]' THEN 'phone_intl'
      WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-' THEN 'ssn'
      WHEN length(regexp_replace({m}, '[^0-9]', '')) = 10 THEN 'phone' ELSE 'card' END"""


def canonical(kind: str, m: str) -> str:
    """SQL for the form in which mentions of one entity agree."""
    return f"""CASE WHEN {kind} IN ('email', 'male', 'female', 'name') THEN lower({m}) WHEN {kind} = 'ip' THEN {m}
      WHEN {kind} = 'iban' THEN replace({m}, ' ', '')
      WHEN {kind} = 'phone_intl' THEN concat(regexp_extract({m}, '^[+]([0-9]+)', 1), '+', regexp_replace(regexp_replace({m}, '^[+][0-9]+', ''), '[^0-9]', ''))
      ELSE regexp_replace({m}, '[^0-9]', '') END"""


def _number(key: str, *parts: str) -> str:
    """SQL for a keyed 48-bit number."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, {', '.join(f'cast({p} AS string)' for p in parts)}), 256), 1, 12), 16, 10) AS bigint)"


def _feistel(key: str, salt: str, left: str, right: str, left_mod: str, right_mod: str) -> str:
    """SQL for struct(l, r): a keyed bijection on pairs below the moduli."""
    return f"""aggregate(sequence(1, 8), struct(cast({left} AS bigint) AS l, cast({right} AS bigint) AS r), (a, i) ->
      IF(i % 2 = 0, struct((a.l + {_number(key, salt, "i", "a.r")}) % {left_mod} AS l, a.r AS r),
                    struct(a.l AS l, (a.r + {_number(key, salt, "i", "a.l")}) % {right_mod} AS r)))"""


def _digits(key: str, kind: str, draw: str, d: str) -> str:
    """SQL for the surrogate digits of a digit string."""
    n = f"length({d})"
    half = f"({n} div 2)"
    pair = _feistel(key, f"concat({kind}, {draw}, '#', {n})", f"coalesce(try_cast(substr({d}, 1, {half}) AS bigint), 0)", f"cast(substr({d}, {half} + 1) AS bigint)", f"cast(pow(10, {half}) AS bigint)", f"cast(pow(10, {n} - {half}) AS bigint)")
    return f"transform(array({pair}), p -> concat(IF({half} = 0, '', lpad(cast(p.l AS string), {half}, '0')), lpad(cast(p.r AS string), {n} - {half}, '0')))[0]"


def _luhn(d: str) -> str:
    """SQL for the sum of a digit string's check, doubling from the last digit but one."""
    return f"aggregate(transform(split(reverse({d}), ''), (c, i) -> IF(c = '', 0, IF(i % 2 = 0, cast(c AS int), (2 * cast(c AS int)) div 10 + (2 * cast(c AS int)) % 10))), cast(0 AS bigint), (a, x) -> a + x)"


def _letters(key: str, kind: str, draw: str, s: str, salt: str) -> str:
    """SQL for a string of s's shape: letters of the same script, digits for digits, other characters kept."""
    h = _number(key, kind, draw, salt, "i")
    grown = f"concat({s}, repeat('a', cast({draw} AS int) div {GROW}))"
    scripts = "\n".join(f"WHEN c RLIKE '\\\\p{{Is{script}}}' THEN substr('{of}', cast({h} % {len(of)} AS int) + 1, 1)" for script, of in SCRIPTS.items())
    return f"""array_join(transform(split({grown}, ''), (c, i) -> CASE
      WHEN c RLIKE '[0-9]' THEN cast({h} % 10 AS string)
      WHEN NOT c RLIKE '\\\\p{{L}}' THEN c
      {scripts}
      WHEN i % 2 = 0 THEN substr('bcdfglmnprstvz', cast({h} % 14 AS int) + 1, 1)
      ELSE substr('aeiou', cast({h} % 5 AS int) + 1, 1) END), '')"""


def _given(key: str, kind: str, names: tuple[str, ...], canon: str, draw: str) -> str:
    """SQL for another given name: a successor in the list's keyed order, then letters that end as the gender's names do."""
    listed = f"array({', '.join(map(_sql, names))})"
    ordered = f"transform(array_sort(transform({listed}, n -> struct(sha2(concat_ws('|', {key}, 'given', n), 256) AS h, n AS n))), o -> o.n)"
    successor = f"transform(array({ordered}), l -> element_at(l, cast((array_position(l, {canon}) + cast({draw} AS int)) % {len(names)} + 1 AS int)))[0]"
    latin, cyrillic = ("a", "а") if names is FEMALE else ("n", "н")
    ended = f"""transform(array({_letters(key, kind, draw, canon, canon)}), v -> CASE WHEN length(v) < 2 THEN v
      WHEN v RLIKE '[a-z]$' THEN concat(left(v, length(v) - 1), '{latin}')
      WHEN v RLIKE '\\\\p{{IsCyrillic}}$' THEN concat(left(v, length(v) - 1), '{cyrillic}') ELSE v END)[0]"""
    return f"IF({draw} < {LIST_DRAWS} AND array_contains({listed}, {canon}), {successor}, {ended})"


def core(key: str, kind: str, canon: str, draw: str) -> str:
    """SQL for the surrogate, in canonical form, of an entity at its draw-th draw."""
    local, domain = f"substring_index({canon}, '@', 1)", f"substring_index({canon}, '@', -1)"
    tld = f"substring_index({domain}, '.', -1)"
    mail = f"concat({_letters(key, kind, draw, local, canon)}, '@', {_letters(key, _sql('domain'), _sql('0'), f'substring_index({domain}, {_sql(".")}, 1)', domain)}, '.example', IF({tld} IN ('com', 'net', 'org'), concat('.', {tld}), ''))"
    octet = lambda k: f"cast(split({canon}, '[.]')[{k}] AS bigint)"
    ip = _feistel(key, f"concat('ip', {draw})", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536")
    ip = f"transform(array({ip}), p -> concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256))[0]"
    body = f"substr({canon}, 1, length({canon}) - 1)"
    fifteen = _digits(key, _sql("luhn"), draw, body)
    card = f"IF({_luhn(canon)} % 10 = 0, transform(array({fifteen}), b -> concat(b, cast((10 - {_luhn('concat(b, 0)')} % 10) % 10 AS string)))[0], {_digits(key, kind, draw, canon)})"
    abroad = f"concat(substring_index({canon}, '+', 1), '+', {_digits(key, f'concat({kind}, substring_index({canon}, {_sql("+")}, 1))', draw, f'substring_index({canon}, {_sql("+")}, -1)')})"
    # The country stays; two digits that would be its check are drawn with the rest.
    iban = f"concat(substr({canon}, 1, 2), {_iban_tail(key, kind, draw, f'substr({canon}, 3)', canon)})"
    return f"""CASE {kind} WHEN 'email' THEN {mail} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} WHEN 'phone_intl' THEN {abroad}
      WHEN 'iban' THEN {iban} WHEN 'male' THEN {_given(key, kind, MALE, canon, draw)} WHEN 'female' THEN {_given(key, kind, FEMALE, canon, draw)}
      WHEN 'name' THEN {_letters(key, kind, draw, canon, canon)} ELSE {_digits(key, kind, draw, canon)} END"""


def _iban_tail(key: str, kind: str, draw: str, s: str, salt: str) -> str:
    h = _number(key, kind, draw, salt, "i")
    return f"array_join(transform(split({s}, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN cast({h} % 10 AS string) WHEN c RLIKE '[A-Z]' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast({h} % 26 AS int) + 1, 1) ELSE c END), '')"


def _dressed(kind: str, m: str, value: str) -> str:
    """SQL for a canonical surrogate in the case and grouping of the match."""
    flat = f"replace({value}, '+', '')"
    filled = f"""aggregate(split({m}, ''), struct('' AS out, 0 AS at), (a, c) ->
      IF(c RLIKE '[A-Z0-9]', struct(concat(a.out, substr({flat}, a.at + 1, 1)) AS out, a.at + 1 AS at), struct(concat(a.out, c) AS out, a.at AS at))).out"""
    return f"""CASE WHEN {kind} = 'email' THEN IF({m} = upper({m}), upper({value}), {value}) WHEN {kind} = 'ip' THEN {value}
      WHEN {kind} IN ('male', 'female', 'name') THEN IF({m} = upper({m}) AND length({m}) > 1, upper({value}), array_join(transform(split({value}, '-'), w -> concat(upper(left(w, 1)), substr(w, 2))), '-'))
      ELSE {filled} END"""


def keyed(df: DataFrame, key: str) -> DataFrame:
    """df with the key in a column, without the key in the plan's text: a local table made in the JVM, read as a subquery."""
    spark = df.sparkSession
    held = spark._jvm.java.util.ArrayList()
    held.add(key)
    table = spark._jsparkSession.createDataset(held, spark._jvm.org.apache.spark.sql.Encoders.STRING()).toDF()
    return df.withColumn(KEY, DataFrame(table, spark).scalar())


def mentioned(rows: DataFrame) -> DataFrame:
    """rows with the text's names, men and women (in lower case) and matches m, in order."""
    text, none = F.col("text"), F.array().cast("array<string>")

    def lower(*patterns: tuple[str, int]) -> Column:
        each = (F.regexp_extract_all(text, F.lit(p), group) for p, group in patterns)
        return F.when(text.rlike(NAME_HINT), F.array_distinct(F.transform(F.concat(*each), F.lower))).otherwise(none)

    behind = lambda titles: (_before(titles, rf"\.? ({_WORD})(?= {_WORD})"), 1)
    listed = _before(tuple(n.capitalize() for n in (*MALE, *FEMALE)), "")
    names = lower((rf"{_TITLED}({_WORD})", 1), (rf"{_TITLED}{_WORD} ({_WORD})", 1), (rf"({listed}) {_WORD}", 1), (rf"{listed} ({_WORD})", 1))
    rows = rows.withColumns({"names": names, "men": lower(behind(MEN)), "women": lower(behind(WOMEN))})
    all_of = F.when(F.size("names") > 0, F.regexp_extract_all(text, F.lit(PATTERN_NAMES), 0)).otherwise(F.regexp_extract_all(text, F.lit(PATTERN), 0))
    return rows.withColumn("m", F.when(text.rlike(HINT), all_of).otherwise(none))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind and canon of every distinct entity in docs."""
    return _named(docs.select(F.col(text).alias("text"))).distinct()


def _named(rows: DataFrame, *kept: Column) -> DataFrame:
    """kept, kind and canon of every entity mentioned in rows."""
    each = mentioned(rows).select(*kept, "names", "men", "women", F.explode(F.array_distinct("m")).alias("m"))
    typed = each.withColumn("kind", F.expr(kind_of("m"))).where("kind IS NOT NULL")
    return typed.withColumn("canon", F.expr(canonical("kind", "m"))).drop("names", "men", "women", "m")


def draws(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, draw and core of every entity: surrogates differ within a type, and from its real values."""
    space = F.when(F.col("kind").isin("male", "female", "name"), "name").otherwise(F.col("kind")).alias("space")
    entity = F.struct("canon", "kind")
    found = stored(found, "entities")
    held = found.select(space, F.col("canon").alias("core"))
    pending, settled = found, []
    for draw in range(MAX_DRAWS):
        if pending.isEmpty():
            break
        cored = keyed(pending, key).withColumn("core", F.expr(core(KEY, "kind", "canon", f"'{draw}'")))
        drawn = stored(cored.select("kind", "canon", F.lit(draw).alias("draw"), "core"), "draws")
        # One entity keeps a surrogate; none if it is held. Combined by surrogate, then a join of equals.
        claims = drawn.select(space, "core", entity.alias("entity"))
        claims = claims.unionByName(held.withColumn("entity", F.lit(None).cast(claims.schema["entity"].dataType)))
        owners = claims.groupBy("space", "core").agg(F.min("entity").alias("owner"), F.bool_or(F.col("entity").isNull()).alias("held"))
        ruled = drawn.withColumn("space", space).join(owners, ["space", "core"])
        ruled = stored(ruled.withColumn("mine", ~F.col("held") & (F.col("owner") == entity)), "ruled")
        settled.append(ruled.where("mine").select("kind", "canon", "draw", "core"))
        held = held.unionByName(settled[-1].select(space, "core"))
        pending = ruled.where("NOT mine").select("kind", "canon")
    else:
        raise ValueError("more entities of a type than surrogates")
    out = found.limit(0).select("kind", "canon", F.lit(0).alias("draw"), F.lit("").alias("core"))
    for s in settled:
        out = out.unionByName(s)
    return out


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, and n_entities (mentions replaced) of every row."""
    again = stored(draws(entities(docs, text), key).where("draw > 0").select("kind", "canon", "draw"), "redrawn")
    rows = mentioned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    if again.isEmpty():
        rows = rows.withColumn("redrawn", F.lit(None).cast("map<string, int>"))
    else:
        # Texts that name an entity drawn again, by digest: copies share a row.
        digest = F.sha2(F.col("text"), 256)
        named = _named(docs.select(F.col(text).alias("text")), digest.alias("digest")).distinct()
        entry = F.struct(F.concat_ws(":", "kind", "canon"), "draw")
        per_text = stored(named.join(again, ["kind", "canon"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(entry)).alias("redrawn")), "renamed")
        # Texts without entities have keys that meet nothing, spread by their row's own hash.
        at = F.when(F.size("m") > 0, digest).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "text").cast("string")))
        rows = rows.withColumn("at", at).join(per_text, F.col("at") == F.col("digest"), "left").drop("at", "digest")
    rows = keyed(rows, key).withColumn("typed", F.expr(f"transform(m, m1 -> named_struct('x', m1, 'k', {kind_of('m1')}))"))
    drawn = "coalesce(cast(redrawn[concat_ws(':', s.k, s.c)] AS string), '0')"
    value = f"transform(array(named_struct('x', t.x, 'k', t.k, 'c', {canonical('t.k', 't.x')})), s -> named_struct('x', s.x, 'k', s.k, 'c', s.c, 'd', {drawn}))"
    value = f"transform({value}, s -> named_struct('x', s.x, 'k', s.k, 'v', {core(KEY, 's.k', 's.c', 's.d')}))"
    new = f"transform(typed, t -> IF(t.k IS NULL, t.x, transform({value}, s -> {_dressed('s.k', 's.x', 's.v')})[0]))"
    parts = F.when(F.size("names") > 0, F.split("text", PATTERN_NAMES, -1)).otherwise(F.split("text", PATTERN, -1))
    joined = F.array_join(F.zip_with(parts, F.expr(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    n_entities = F.size(F.filter("typed", lambda t: t.k.isNotNull())).cast("long").alias("n_entities")
    return rows.select("doc_id", F.when(F.size("m") > 0, joined).otherwise(F.col("text")).alias("text"), n_entities)
