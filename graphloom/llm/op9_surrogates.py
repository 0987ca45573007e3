"""Personal data replaced by surrogates, with DataFrame and SQL functions only.

Detection is one regular expression over texts that hold a digit, an at sign, a key word or a title
at all. Each mention is normalised to an entity (type and normal form); the same entity gets the same
surrogate everywhere, across spellings. A surrogate is derived from a keyed SHA-256 of the entity and
an attempt number and keeps type and format: digits stay digits and separators stay where they are,
card numbers stay valid where they were, names keep gender (from a title; with Dr and the like, the gender the same name has elsewhere in the text) and script, secrets keep
their alphabet. Collision checks: a surrogate that equals a real entity of its type, or the surrogate
of another entity, is made again with the next attempt, until all are distinct; late attempts are longer
than the mention, so that even a key space that is used up leaves room. Names are found after a title or
a well-known given name, and then followed where they stand alone in the same document: the full name,
the given names and the surname, each by its own surrogate.

Every repetition in the patterns is bounded or runs over a single class of characters, so the matcher
neither recurses with the length of a text nor goes back over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut, join_checked

# Titles by gender, given names by gender and script, syllables of surnames.
TITLES_M = ["Mr", "Sir", "Herr", "Señor", "Monsieur", "Lord", "господин"]
TITLES_F = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Madame", "Mme", "Lady", "госпожа"]
TITLES_N = ["Dr", "Prof", "Professor", "Doctor", "Doktor", "Mx"]
GIVEN = {
    "m_latin": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"],
    "f_latin": ["Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karin", "Laura", "Marta", "Nora", "Olga", "Paula"],
    "m_cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    "f_cyrillic": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Мария"],
}
SYLLABLES = {
    "latin": ["ba", "del", "fen", "gor", "hal", "jan", "kel", "lor", "man", "nev", "pol", "ran", "sel", "tor", "var", "wen"],
    "cyrillic": ["бар", "вел", "гор", "дан", "зор", "кал", "лев", "мал", "нев", "пол", "рад", "сев", "тар", "фед", "хар", "чер"],
}
#: Given names that introduce a person without a title, and capitalised words that never end a name.
KNOWN_M = """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Paul George Kenneth Edward
Brian Kevin Peter Henry Adam Martin Simon Hans Klaus Jürgen Wolfgang Stefan Andreas Markus Matthias Karl Pierre Jacques François Philippe
Michel Laurent Juan José Carlos Luis Miguel Pedro Javier Fernando Antonio Manuel Diego Pablo""".split()
KNOWN_F = """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Anna Maria Emily Emma Alice
Helen Julia Laura Ursula Monika Sabine Petra Claudia Katrin Marie Sophie Claire Isabelle Camille Nathalie Chantal Carmen Ana Isabel Lucía
Marta Pilar Elena Eva Ada Olivia Charlotte Hannah Rachel""".split()
NO_NAMES = """Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November
December Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Mai Juni Juli Oktober Dezember Enero Febrero""".split()
KEY_WORDS = "password|passwd|pwd|token|secret|api[_-]?key"

#: Letters of scripts with case: those that names are written in.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_ANY_TITLE = "|".join(sorted(TITLES_M + TITLES_F + TITLES_N, key=len, reverse=True))
#: An apostrophe before a last s is not part of a name.
_JOINED = rf"(?:['’-](?=[{_CASED}])(?!s(?![{_CASED}]))[{_CASED}]++)"
_NAME = rf"\p{{Lu}}(?:[{_CASED}]++{_JOINED}{{0,8}}|{_JOINED}{{1,8}})"
_NEXT_NAME = rf"[ ](?!(?:Mr|Mrs|Ms|Mme|Dr|Prof|Mx)\.)(?!(?:{'|'.join(NO_NAMES)})(?![{_CASED}])){_NAME}"
_KNOWN = "|".join(sorted(KNOWN_M + KNOWN_F, key=len, reverse=True))
_BARE = r"""[!-~&&[^"'`,;<>&]]"""
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Entity types in order of preference, with their patterns.
PATTERNS = {
    # A local part has at most 64 characters, a host at most 127 labels of 63.
    "email": r"[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,63}",
    # In quotes anything; without, printable ASCII with a letter or digit, and a digit or symbol or eight characters.
    "secret": rf"""(?i:{KEY_WORDS})["']?[ \t]{{0,3}}[=:][ \t]{{0,3}}(?:"[^"\r\n]++(?="|$)|'[^'\s]++(?='|$)"""
    rf"""|(?=[+/_-]{{0,64}}[A-Za-z0-9]|{_BARE}{{0,64}}[A-Za-z0-9])(?:(?={_BARE}{{0,4096}}[0-9!#$%^*@+=~]){_BARE}{{3,4096}}[!-~&&[^"'`,;<>&.:!?)\]}}]]"""
    rf"""|["']?[A-Za-z0-9+/_-]{{8,4096}}))""",
    "access_key": r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9_])",
    "ipv6": rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]{{0,38}}+[0-9])(?:[0-9A-Fa-f]{{2,4}}(?::{_HEX}){{0,6}}|(?<!:))::(?:(?:{_HEX}:){{0,5}}(?:(?:{_OCTET}\.){{3}}{_OCTET}|{_HEX}))?)(?![A-Za-z0-9_:])",
    "ipv4": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9]|[A-Za-z_])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![A-Za-z0-9_])"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![A-Za-z0-9_])|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_])"
    r"|0[1-9](?:[ .-][0-9]{2}){4}(?![A-Za-z0-9_])|0[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![A-Za-z0-9_])|0[0-9]{4}[ -][0-9]{6}(?![A-Za-z0-9_])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9_])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "person": rf"(?:(?:(?:{_ANY_TITLE})\.?[ ]){{1,3}}{_NAME}(?:{_NEXT_NAME}){{0,2}}|(?=\p{{Lu}})(?:{_KNOWN})(?:{_NEXT_NAME}){{1,2}})",
}
#: What must not stand before a mention: for most types their own characters, for key words nothing.
_BEFORE = {"secret": "", "person": rf"(?<![{_CASED}\p{{N}}_])"}
ANY = "(?:" + "|".join(f"{_BEFORE.get(t, '(?<![A-Za-z0-9_])')}(?:{p})" for t, p in PATTERNS.items()) + ")"
#: What no mention of a name can do without; only capitals that begin a title or a known name are looked at.
_HEADS = "".join(sorted({w[0] for w in TITLES_M + TITLES_F + TITLES_N + KNOWN_M + KNOWN_F}))
NAMED = rf"(?=[{_HEADS}])(?:(?:{_ANY_TITLE})[. ]|(?:{_KNOWN}) \p{{Lu}})"


def _hinted(body: Column) -> Column:
    """A cheap first look: whether a text has what some mention needs at least: a digit or an at sign; the
    head of an access key, or an IPv6 address of letters alone; a key word; a name."""
    return body.rlike("[0-9@]") | body.rlike("AKIA|(?:[A-Fa-f]{1,4}:){7}") | (body.rlike("[=:]") & body.rlike(f"(?i:{KEY_WORDS})")) | body.rlike(NAMED)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _type_of(m: str) -> str:
    whens = " ".join(f"WHEN {m} RLIKE {_sql('^(?:' + p + ')$')} THEN '{t}'" for t, p in PATTERNS.items())
    return f"CASE {whens} END"


_TITLE = rf"^((?:(?:{_ANY_TITLE})\.?[ ])+)"
_SECRET_KEY = rf"""^(?i:{KEY_WORDS})["']?[ \t]{{0,3}}[=:][ \t]{{0,3}}["']?"""


def _parts_of(m: str) -> str:
    """A mention -> its parts as structs of type, value, normal form and what stands before it."""
    titled = lambda titles: f"{m} RLIKE {_sql('^(?:[' + _CASED + ']+[.]?[ ])*(?:' + '|'.join(titles) + ')[.]?[ ]')}"
    gender = f"CASE WHEN {titled(TITLES_F)} THEN 'f' WHEN {titled(TITLES_M)} THEN 'm' ELSE 'n' END"
    script = lambda v: f"IF({v} RLIKE {_sql('[А-Яа-яЁё]')}, 'cyrillic', 'latin')"
    names = f"split(regexp_replace({m}, {_sql(_TITLE)}, ''), ' ')"
    person = f"""transform({names}, (v, i) -> named_struct(
        'kind', IF(i = size({names}) - 1, concat('surname_', {script('v')}), concat('given_', {gender}, '_', {script('v')})),
        'value', v, 'normal', v,
        'before', IF(i = 0, regexp_extract({m}, {_sql(_TITLE)}, 1), ' ')))"""
    secret = f"regexp_replace({m}, {_sql(_SECRET_KEY)}, '')"
    address = f"lower({m})"
    groups = lambda side: f"filter(split(substring_index({address}, '::', {side}), ':'), g -> g <> '')"
    # The full form without leading zeros: one entity in all its spellings.
    ipv6 = f"""array_join(transform(IF(instr({m}, '::') = 0, {groups(1)}, concat({groups(1)},
        array_repeat('0', greatest(8 - size({groups(1)}) - size({groups(-1)}), 0)), {groups(-1)})), g -> regexp_replace(g, '^0+(?=.)', '')), ':')"""
    one = lambda kind, value, normal, before="''": f"array(named_struct('kind', {kind}, 'value', {value}, 'normal', {normal}, 'before', {before}))"
    kind = _type_of(m)
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return f"""CASE ({kind})
      WHEN 'person' THEN {person}
      WHEN 'secret' THEN {one("'secret'", secret, secret, f"substr({m}, 1, length({m}) - length({secret}))")}
      WHEN 'phone' THEN {one("'phone'", m, digits)}
      WHEN 'card' THEN {one("'card'", m, digits)}
      WHEN 'ssn' THEN {one("'ssn'", m, digits)}
      WHEN 'iban' THEN {one("'iban'", m, f"regexp_replace({m}, ' ', '')")}
      WHEN 'ipv6' THEN {one("'ipv6'", m, ipv6)}
      WHEN 'email' THEN {one("'email'", m, f"lower({m})")}
      ELSE {one(kind, m, m)} END"""


def _number(salt: str) -> str:
    """A number below 2**48 from the seed (of key, entity and attempt) and a salt."""
    return f"CAST(conv(substr(sha2(concat_ws('|', seed, {salt}), 256), 1, 12), 16, 10) AS BIGINT)"


def _pick(items: list[str], salt: str) -> str:
    return f"element_at(array({', '.join(map(_sql, items))}), CAST({_number(salt)} % {len(items)} AS INT) + 1)"


def _like(value: str, keep: str = "0", salt: str = "i") -> str:
    """Characters after the first `keep` replaced by others of their class, in one pass over the value."""
    letters, hexed = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    draw = lambda alphabet: f"substr('{alphabet}', CAST({_number(salt.replace('i', '(i + 1)'))} % {len(alphabet)} AS INT) + 1, 1)"
    return f"""transform(array({value} RLIKE '^[0-9a-f]+$' AND {value} RLIKE '[a-f]'), hexed ->
      array_join(transform(filter(split({value}, ''), c -> c <> ''), (c, i) -> CASE
        WHEN i < {keep} THEN c
        WHEN hexed THEN {draw(hexed)}
        WHEN c BETWEEN '0' AND '9' THEN {draw('0123456789')}
        WHEN c BETWEEN 'a' AND 'z' THEN {draw(letters)}
        WHEN c BETWEEN 'A' AND 'Z' THEN {draw(letters.upper())}
        ELSE c END), ''))[0]"""


def _luhn(digits: str) -> str:
    """The Luhn sum of a digit string modulo 10; 0 for valid numbers."""
    d = f"CAST(substr({digits}, length({digits}) - j, 1) AS INT)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, j) -> s + IF(j % 2 = 0, {d}, IF({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10"


def _mod97(iban: str) -> str:
    moved = f"concat(substr({iban}, 5), substr({iban}, 1, 4))"
    return f"""aggregate(filter(split({moved}, ''), c -> c <> ''), 0, (s, c) -> IF(c BETWEEN '0' AND '9',
        (s * 10 + CAST(c AS INT)) % 97, (s * 100 + ascii(c) - 55) % 97))"""


#: Attempts whose surrogates have the mention's own length.
PLAIN_ATTEMPTS = 3


def _surrogate() -> Column:
    """From columns kind, normal, attempt, seed."""
    whens = []
    for script in ("latin", "cyrillic"):
        syllable = lambda n: _pick(SYLLABLES[script], f"'s{n}'")  # noqa: B023, E731
        # One more syllable every two attempts: there is always room.
        surname = f"initcap(concat({syllable(1)}, {syllable(2)}, {syllable(3)}, array_join(transform(sequence(0, attempt DIV 2), i -> {_pick(SYLLABLES[script], 'i')}), '')))"
        whens.append(f"WHEN kind = 'surname_{script}' THEN {surname}")
        for gender in "mfn":
            names = GIVEN[f"m_{script}"] + GIVEN[f"f_{script}"] if gender == "n" else GIVEN[f"{gender}_{script}"]
            # Plain names first; then hyphenated ones, longer with every two attempts.
            more = f"array_join(transform(sequence(0, attempt DIV 2), i -> {_pick(names, 'i')}), '-')"
            whens.append(f"WHEN kind = 'given_{gender}_{script}' THEN IF(attempt < 2, {_pick(names, chr(39) + 'g' + chr(39))}, {more})")
    # Late attempts are longer: digits for numbers, letters for the rest.
    late = f"greatest(attempt - {PLAIN_ATTEMPTS}, 0)"
    longer = f"concat(normal, repeat('0', {late}))"
    letters = f"array_join(transform(filter(sequence(0, {late}), i -> i > 0), i -> {_pick(list('abcdefghijklmnopqrstuvwxyz'), '-i')}), '')"
    domain = "regexp_extract(normal, '@(.*)[.]', 1)"
    local = "regexp_extract(normal, '^(.*)@', 1)"
    ending = "regexp_extract(normal, '([.][a-z]+)$', 1)"
    email = f"concat({_like(local)}, {letters}, '@', {_like(domain, salt='-i')}, {ending})"
    card = _like(longer, "1")
    checked = f"transform(array({card}), d -> IF({_luhn('normal')} = 0, concat(substr(d, 1, length(d) - 1), CAST((10 - {_luhn('concat(substr(d, 1, length(d) - 1), ' + chr(39) + '0' + chr(39) + ')')}) % 10 AS STRING)), d))[0]"
    iban = f"transform(array({_like(longer, '2')}), d -> IF({_mod97('normal')} = 1, concat(substr(d, 1, 2), lpad(CAST(98 - {_mod97('concat(substr(d, 1, 2), ' + chr(39) + '00' + chr(39) + ', substr(d, 5))')} AS STRING), 2, '0'), substr(d, 5)), d))[0]"
    octets = f"concat(array_join(transform(sequence(1, 4), i -> CAST({_number('i')} % 254 + 1 AS STRING)), '.'), IF({late} > 0, concat(':', {_number('5')} % 65536), ''))"
    groups = f"array_join(transform(sequence(1, 8), i -> lower(hex({_number('i')} % 65536))), ':')"
    phone = _like(longer, "IF(length(normal) > 10, length(normal) - 10, 0)")
    # Letters of other scripts become ASCII letters, symbols others.
    secret = f"""concat(array_join(transform(filter(split({_like('normal')}, ''), c -> c <> ''), (c, i) -> CASE
        WHEN c RLIKE '[A-Za-z0-9+/_=-]|[ ]' THEN c WHEN c RLIKE '[!-~]' THEN {_pick(list('!#%*?@'), 'i')}
        ELSE {_pick(list('abcdefghijklmnopqrstuvwxyz'), 'i')} END), ''), {letters})"""
    whens += [
        f"WHEN kind = 'email' THEN {email}", f"WHEN kind = 'card' THEN {checked}", f"WHEN kind = 'iban' THEN {iban}",
        f"WHEN kind = 'ipv4' THEN {octets}", f"WHEN kind = 'ipv6' THEN {groups}", f"WHEN kind = 'phone' THEN {phone}",
        f"WHEN kind = 'access_key' THEN {_like(longer, '4')}", f"WHEN kind = 'secret' THEN {secret}", f"ELSE {_like(longer)}",
    ]
    return F.expr("CASE " + " ".join(whens) + " END")


#: The surrogate of a normal form, put into the spelling of the mention.
_RENDER = """CASE WHEN kind IN ('phone', 'card', 'ssn', 'iban') THEN aggregate(
    filter(split(value, ''), c -> c <> ''), named_struct('done', '', 'at', 1),
    (s, c) -> IF(c RLIKE '[0-9A-Z]', named_struct('done', concat(s.done, substr(surrogate, s.at, 1)), 'at', s.at + 1),
                 named_struct('done', concat(s.done, c), 'at', s.at)), s -> concat(s.done, substr(surrogate, s.at))) ELSE surrogate END"""


#: Words of names that stand together, as they are followed between mentions.
_FOLLOWED = rf"(?<![{_CASED}\p{{N}}_]){_NAME}(?: {_NAME}){{0,2}}(?![{_CASED}\p{{N}}_])"


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal) -> with surrogate, distinct within a kind and unlike any real entity of it.

    The first attempt settles nearly all; a later one scans what is taken against the few that are
    left. Surrogates grow with the attempts, so the rounds end however full the key space is.
    """
    entities = cut(entities.where("kind is not null").select("kind", "normal").distinct(), "entities")
    taken = entities.withColumnRenamed("normal", "surrogate")
    pending, done, attempt = entities, None, 0
    while True:
        seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "normal", F.lit(attempt)), 256)
        tried = cut(pending.withColumn("attempt", F.lit(attempt)).withColumn("seed", seed).withColumn("surrogate", _surrogate()).select("kind", "normal", "surrogate"), "tried")
        best = tried.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        if attempt == 0:
            best = best.join(taken, ["kind", "surrogate"], "left_anti")
        else:
            met = cut(join_checked(taken, tried.select("kind", "surrogate").distinct(), ["kind", "surrogate"], "left_semi").distinct(), "met")
            best = join_checked(best, met, ["kind", "surrogate"], "left_anti")
        best = cut(best.select("kind", "normal", "surrogate"), "assigned")
        done = best if done is None else done.unionAll(best)
        taken = taken.unionAll(best.select("kind", "surrogate"))
        pending = cut(tried.join(best, ["kind", "normal"], "left_anti").select("kind", "normal"), "pending")
        if pending.isEmpty():
            return done
        attempt += 1


def _followed(shown: DataFrame) -> DataFrame:
    """sha -> names: every name part and every full name of a text with its surrogate; a full name goes
    before a part of the same spelling, then the first mention decides."""
    people = shown.where(F.col("kind").rlike("^(?:given|surname)_"))
    parts = F.sort_array(F.collect_list(F.struct("pi", "value", "shown")))
    joined = lambda field: F.array_join(F.transform("ps", lambda p: p[field]), " ").alias(field)
    full = people.groupBy("sha", "mi").agg(parts.alias("ps")).select("sha", joined("value"), joined("shown"), F.lit(0).alias("rank"), "mi", F.lit(0).alias("pi"))
    every = full.unionByName(people.select("sha", "value", "shown", F.lit(1).alias("rank"), "mi", "pi"))
    best = every.groupBy("sha", "value").agg(F.min_by("shown", F.struct("rank", "mi", "pi")).alias("shown"))
    return best.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("value", "shown"))).alias("names"))


def pseudonymise(docs: DataFrame, key: str = "graphloom", count: str | None = "n_entities") -> DataFrame:
    """docs with detected entities in `text` replaced, and their number in a new column (unless count
    is None). Where n_chars is a column, it is brought up to date.

    All other columns pass through, null and repeated rows included; a null text stays null with 0
    entities. A text is processed whole. The result is a function of the table's texts and the key:
    equal texts become equal texts. Columns of the names that are used inside do not clash.
    """
    names = docs.columns
    # Only texts with a mention go further; they are keyed by their SHA-256.
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("text").alias("body"))
    marked = packed.withColumn("hit", F.coalesce(_hinted(F.col("body")) & F.col("body").rlike(ANY), F.lit(False)))
    hits = cut(marked.where("hit").select("row", "body", F.sha2("body", 256).alias("sha")), "hits")
    texts = hits.groupBy("sha").agg(F.first("body").alias("body"))
    mentions = texts.select("sha", F.posexplode(F.expr(f"regexp_extract_all(body, {_sql(ANY)}, 0)")).alias("mi", "m"))
    gendered = F.min(F.when(F.col("kind").rlike("^given_[mf]"), F.col("kind"))).over(Window.partitionBy("sha", "value"))
    of = lambda gender, names: F.when(F.col("value").isin(names), F.regexp_replace("kind", "^given_n", f"given_{gender}"))
    known_gender = F.coalesce(of("m", KNOWN_M), of("f", KNOWN_F), F.col("kind"))
    parts = cut(
        mentions.select("sha", "mi", F.posexplode(F.expr(_parts_of("m"))).alias("pi", "part")).select("sha", "mi", "pi", "part.*")
        .withColumn("kind", F.when(F.col("kind").startswith("given_n"), F.coalesce(gendered, known_gender)).otherwise(F.col("kind"))),
        "parts",
    )
    known = surrogates(parts, key)
    shown = cut(parts.join(known, ["kind", "normal"], "left").withColumn("shown", F.coalesce(F.expr(_RENDER), "value")), "shown")
    one = shown.groupBy("sha", "mi").agg(F.sort_array(F.collect_list(F.struct("pi", F.concat("before", "shown").alias("out")))).alias("parts"))
    outs = one.select("sha", "mi", F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("out"))
    outs = outs.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("mi", "out"))).alias("outs"))  # mi runs from 0 without gaps
    replaced = outs.join(_followed(shown), "sha", "left").withColumn("n", F.size("outs"))
    # Between mentions, names of the document that stand alone follow their surrogate, all in one pass.
    whole = "coalesce(names[v], array_join(transform(split(v, ' '), w -> coalesce(names[w], w)), ' '))"
    follow = f"""IF(names IS NULL OR NOT gap RLIKE {_sql(_FOLLOWED)}, gap, array_join(zip_with(
        split(gap, {_sql(_FOLLOWED)}, -1), regexp_extract_all(gap, {_sql(_FOLLOWED)}, 0), (g, v) -> concat(g, coalesce({whole}, ''))), ''))"""
    rebuilt = F.expr(f"""array_join(transform(split(body, {_sql(ANY)}, -1), (gap, i) -> concat({follow}, coalesce(get(outs, i).out, ''))), '')""")
    changed = hits.join(replaced, "sha").select("row", rebuilt.alias("fresh"), F.col("n").cast("int").alias("n"))
    clean = marked.where(~F.col("hit")).select("row", F.col("body").alias("fresh"), F.lit(0).alias("n"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("fresh").alias("text")
        if name == "n_chars":
            return F.when(F.col("n") > 0, F.length("fresh")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"row.`{name}`").alias(name)

    extra = [F.col("n").alias(count)] if count else []
    return changed.unionAll(clean).select(*[column(n) for n in names if n != count or not count], *extra)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", "n_entities")
