"""Surrogates for personal data, in DataFrame functions only.

One pattern finds all entities of a text. Each gets a replacement that a keyed hash makes from its normal form: the same entity gets the
same one everywhere (coreference), of the same kind and shape:
  e-mail addresses keep their shape and top-level domain, and addresses at one domain stay at one domain; telephone numbers keep country code and
  punctuation; IPv6 addresses are one entity in all spellings, and come back in full form; card numbers keep their first digit and grouping and pass the same check sum; IBANs keep country and grouping and
  have right check digits; IP addresses stay valid; social-security numbers and secrets keep punctuation, case and the kinds of
  their characters, and a key's public prefix;
  names after titles, labels or a listed given name, over initials, particles and up to four capitalised words: each word gets a name of the same
  script (Latin, Greek, Cyrillic), case and, for a given name, gender; a family name gets the same one with or without title or given
  name, and where it stands alone in a text that has it in such a name. An initial becomes another letter's; particles stay.

Collisions: the distinct entities of the corpus, per kind, are grouped by their surrogate. Of several entities with one surrogate all but
the first, and any whose surrogate is itself an entity of the corpus, try again with the next attempt's hash, until none collides; what is settled
stays. A shape may have no free value left (all one-letter domains are real): from attempt GROW on each attempt adds a character to the surrogate (an
IPv4 address becomes an IPv6 one), so there always is one. Nearly all entities keep attempt 0; only the others are carried to the texts that hold them,
by a join on the text's hash, which broadcasts up to MAP_BOUND of them (counted) and shuffles beyond that.

Texts are scanned twice: once for the table of their entities, from which collisions and the few later attempts are worked out, and once to
be rewritten. Patterns are linear in a text and need no stack that grows with it (repeated groups are possessive or bounded), and nothing that is
found is cut at a length.

Defined results: null stays null and empty stays empty; texts without entities come back unchanged, byte for byte; repeated rows
are rewritten alike; other columns, whatever their names, are carried along unread. The key is a parameter; without it surrogates can't be
recomputed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tarn.llm.common import materialize, once, release

#: Moved entities of texts that are broadcast; the attempt from which on surrogates grow.
MAP_BOUND, GROW = 20_000, 6

#: Titles and given names by gender, and syllables by script.
TITLES_F = "Mrs Ms Miss Madam Lady Frau Mme Mlle Madame Sra Srta Señora Señorita".split()
TITLES_M = "Mr Sir Lord Herr Monsieur Sr Señor".split()
TITLES_N = "Dr Prof Professor".split()
GIVEN_F = "Mary Anna Maria Emma Laura Julia Sarah Sofia Elena Olga Natalia Marie Claire Isabel Carmen Lucia Ingrid Helga Alice Jane Linda Susan Ελένη Μαρία Анна Мария Ольга".split()
GIVEN_M = "John James Peter Paul Thomas Michael David Robert William Hans Karl Jean Pierre Juan Carlos Pedro Luis Ivan Sergei Alexander Martin Frank Γιώργος Νίκος Иван Сергей Пётр".split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va".split(),
    "greek": "βα βε βο δα δε δο φα φε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το ζα".split(),
    "cyrillic": "ба бе бо да де до фа фе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва".split(),
}
ENDINGS = {"latin": {"f": "lina", "m": "ldo", "s": "ner"}, "greek": {"f": "λίνα", "m": "ρος", "s": "νης"}, "cyrillic": {"f": "лина", "m": "мир", "s": "нов"}}

#: Kinds in the order in which they are tried at a place; no kind matches across a line.
NAME = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))(?=\p{L}))++"
PARTICLES = "von van der den de del della di da dos du la le ten ter zu zum zur bin ibn al el y".split()
BEFORE = rf"(?:\p{{Lu}}\.? ){{0,3}}(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
#: Words of a text as names are compared with them: without a genitive's ending.
WORD = r"\p{L}++(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
#: What stands before a name in forms and letters.
LABELS = "Name Contact Author Signed Customer Patient Attn From To".split()
HEX, BYTE = "[0-9A-Fa-f]{1,4}", r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
KINDS = {
    "email": r"(?:(?<![._%+-])|(?<![\p{L}\p{M}\p{N}][._%+-]{1,3}))[\p{L}\p{N}_][\p{L}\p{M}\p{N}._%+-]*+@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)++",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?=[0-9A-Fa-f]{{0,4}}:)(?=[0-9A-Fa-f:]{{0,45}}\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}(?::{HEX}){{0,5}})?::(?:{HEX}:){{0,5}}(?:{BYTE}\.){{3}}{BYTE}|(?:{HEX}(?::{HEX}){{0,6}})?::(?:{HEX}(?::{HEX}){{0,6}})?)(?![\w:]|\.\d)",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\w)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|\d{3}[.-]\d{3}[.-]\d{4}(?!\w)",
    "person": rf"(?=\p{{Lu}})(?:(?:(?:{'|'.join(TITLES_F + TITLES_M + TITLES_N)})\.? ){{1,3}}{BEFORE}{NAME}(?: {BEFORE}{NAME}){{0,3}}|(?:{'|'.join(GIVEN_F + GIVEN_M)})(?:-\p{{Lu}}\p{{L}}++)?(?: {BEFORE}{NAME}){{1,3}}"
    rf"|(?:(?:{'|'.join(LABELS)}):|Dear) {NAME}(?: {BEFORE}{NAME}){{1,3}})",
    "secret": r"(?=[AaGgPpSsTtx])(?:(?:AKIA|ASIA)[A-Z0-9]{16,}+|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|(?:[Pp]ass(?:word|wd|phrase)|PASSWORD|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey)(?:[_-][A-Za-z]{1,20})? {0,3}[=:] {0,3}[\"']?[A-Za-z0-9+/_.~-]{6,}+)",
}
#: A secret's name may follow an underscore.
PATTERN = r"(?<![\p{L}\p{N}@])(?=[\p{L}\p{N}+(:_])(?:(?<!_)(?:" + "|".join(p for name, p in KINDS.items() if name != "secret") + ")|" + KINDS["secret"] + ")"
#: Country calling codes (E.164): no code begins another one.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PREFIX = r"^((?:AKIA|ASIA)|gh[pousr]_|sk-|xox[abprs]-|[A-Za-z0-9_-]+ *[=:] *[\"']?)"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def kind_of(raw: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in KINDS.items():
        out = out.when(raw.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out.otherwise(F.lit("secret"))


def _full_ip6(low: Column) -> Column:
    """Eight groups without leading zeros, from any spelling in lower case; one that ends in an IPv4 address has its bytes as two groups."""
    last = F.transform(F.split(F.regexp_extract(low, r"([\d.]+)$", 1), r"\."), lambda x: x.try_cast("int"))
    pair = lambda i: F.lower(F.hex(F.get(last, F.lit(i)) * 256 + F.get(last, F.lit(i + 1))))
    plain = F.when(F.instr(low, ".") > 0, F.concat(F.regexp_replace(low, r"[\d.]+$", ""), pair(0), F.lit(":"), pair(2))).otherwise(low)
    groups = lambda x: F.regexp_extract_all(x, F.lit("[0-9a-f]+"), 0)
    left, right = groups(F.substring_index(plain, "::", 1)), groups(F.substring_index(plain, "::", -1))
    every = F.when(F.instr(plain, "::") > 0, F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)).otherwise(groups(plain))
    return F.array_join(F.transform(every, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def normal(raw: Column, kind: Column) -> Column:
    """What is one entity: addresses without case, numbers without punctuation, secrets without what stands before them."""
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind.isin("phone", "card", "ssn"), F.concat(F.when(raw.startswith("+"), F.lit("+")).otherwise(F.lit("")), F.regexp_replace(raw, r"\D", "")))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "secret", F.regexp_replace(raw, PREFIX, ""))
        .when(kind == "ip6", _full_ip6(F.lower(raw)))
        .otherwise(raw)
    )


def _number(hash_: Column, at: Column) -> Column:
    """A number below 4096 from place `at` of a hash of 128 hex digits."""
    return F.conv(F.substring(hash_, F.pmod(at * 3, F.lit(126)) + 1, F.lit(3)), 16, 10).cast("int")


def _hash(key: str, kind: str, what: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), attempt.cast("string"), what), 512)


#: Letters by script, for those that aren't ASCII; scripts that aren't named get ASCII ones.
OTHER = {"Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _shaped(text: Column, hash_: Column, hexadecimal: Column | None = None) -> Column:
    """Each digit and letter replaced by one of its kind; the count of letters and digits before a character picks its number, so
    punctuation doesn't matter. hexadecimal: where true, lower-case letters stay within a-f."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def other(c, n):
        low = _pick(LOWER, n)
        for script, letters in OTHER.items():
            low = F.when(c.rlike(rf"^\p{{Is{script}}}"), _pick(letters, n)).otherwise(low)
        return F.when(c.rlike(r"^\p{N}"), _pick(DIGITS, n)).when(~c.rlike(r"^\p{L}"), c).when(c != F.lower(c), F.upper(low)).otherwise(low)

    def each(c, i):
        n = _number(hash_, i)
        low = _pick(LOWER, n) if hexadecimal is None else F.when(hexadecimal, _pick("abcdef", n)).otherwise(_pick(LOWER, n))
        return F.when(c.between("0", "9"), _pick(DIGITS, n)).when(c.between("a", "z"), low).when(c.between("A", "Z"), _pick(UPPER, n)).when(c < "\x80", c).otherwise(other(c, n))

    return F.array_join(F.transform(chars, each), "")


def _digits_into(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by digits, one after another."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), F.struct(F.concat(a["out"], F.substring(digits, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda a: a["out"])


def _longer(text: Column, attempt: Column, by: str) -> Column:
    """text with a character more for each attempt from GROW on."""
    return F.when(attempt < GROW, text).otherwise(F.concat(text, F.repeat(F.lit(by), attempt - GROW + 1)))


def _random_digits(n: Column, hash_: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pick(DIGITS, _number(hash_, i))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that a check digit is still to follow."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(raw: Column, hash_: Column, attempt: Column) -> Column:
    plain, shape = F.regexp_replace(raw, r"\D", ""), _longer(raw, attempt, "0")
    n = F.length(F.regexp_replace(shape, r"\D", ""))
    body = F.concat(F.substring(plain, 1, 1), _random_digits(n - 2, hash_))
    valid = F.pmod(_luhn_sum(F.substring(plain, F.lit(1), F.length(plain) - 1)) + F.substring(plain, -1, 1).cast("int"), F.lit(10)) == 0
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(body), F.lit(10)), F.lit(10))
    off = F.pmod(check + 1 + F.pmod(_number(hash_, n), F.lit(9)), F.lit(10))
    return _digits_into(shape, F.concat(body, F.when(valid, check).otherwise(off).cast("string")))


def _iban(raw: Column, hash_: Column, attempt: Column) -> Column:
    plain = F.regexp_replace(raw, " ", "")
    body = _shaped(_longer(F.substring(plain, F.lit(5), F.length(plain)), attempt, "0"), hash_)
    chars = F.filter(F.split(F.concat(body, F.substring(plain, 1, 2), F.lit("00")), ""), lambda c: c != "")
    left = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.between("0", "9"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))
    fresh = F.concat(F.substring(plain, 1, 2), F.lpad((98 - left).cast("string"), 2, "0"), body)
    spaced = F.concat_ws(" ", F.regexp_extract_all(fresh, F.lit(r".{1,4}"), 0))
    return F.when(F.instr(raw, " ") > 0, spaced).otherwise(fresh)


def _ip(raw: Column, hash_: Column, attempt: Column) -> Column:
    four = F.array_join(F.transform(F.split(raw, r"\."), lambda _, i: (1 + F.pmod(_number(hash_, i), F.lit(254))).cast("string")), ".")
    return F.when(attempt < GROW, four).otherwise(_ip6(hash_))


def _ip6(hash_: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.hex(F.lit(4096) + _number(hash_, i)))), ":")


def _domain(domain: Column, key: str, attempt: Column) -> Column:
    stem, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    return F.concat(_let(_hash(key, "domain", domain, attempt), lambda h: _shaped(_longer(stem, attempt, "x"), h)), top)


def _email(raw: Column, key: str, attempt) -> Column:
    low = F.lower(raw)
    local, domain, n = F.substring_index(raw, "@", 1), F.substring_index(low, "@", -1), attempt(F.lit("email"), low)
    return F.concat(_let(_hash(key, "email", low, n), lambda h: _shaped(_longer(local, n, "x"), h)), F.lit("@"), _domain(domain, key, attempt(F.lit("domain"), domain)))


def _phone(raw: Column, what: Column, hash_: Column, attempt: Column) -> Column:
    """Country code and digits come from the normal form, so that all spellings of a number have the same ones."""
    code = F.regexp_extract(what, COUNTRY, 1)
    n = F.length(F.regexp_replace(_longer(what, attempt, "0"), r"\D", "")) - F.length(code)
    return _digits_into(_longer(raw, attempt, "0"), F.concat(code, _random_digits(n, hash_)))


def _secret(raw: Column, hash_: Column, attempt: Column) -> Column:
    prefix = F.regexp_extract(raw, PREFIX, 1)
    value = F.substring(raw, F.length(prefix) + 1, F.length(raw))
    return F.concat(prefix, _shaped(_longer(value, attempt, "0"), hash_, value.rlike(r"^[0-9a-f]++$")))


def _name(word: Column, role: Column, key: str, attempt: Column) -> Column:
    """A made-up name for one word of a name: role f or m for a given name of that gender, s for a family name."""
    script = F.when(word.rlike(r"^\p{IsGreek}"), "greek").when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def made(name, hash_):
        pool = F.split(F.lit(" ".join(SYLLABLES[name])), " ")
        stem = F.array_join(F.transform(F.sequence(F.lit(0), 2 + attempt), lambda i: F.get(pool, F.pmod(_number(hash_, i), F.lit(len(SYLLABLES[name]))))), "")
        return F.concat(stem, F.when(role == "f", ENDINGS[name]["f"]).when(role == "m", ENDINGS[name]["m"]).otherwise(ENDINGS[name]["s"]))

    def in_script(hash_):
        out = made("latin", hash_)
        for name in SYLLABLES:
            out = F.when(script == name, made(name, hash_)).otherwise(out)
        return out

    cased = lambda out: F.when((F.length(word) > 1) & (F.upper(word) == word), F.upper(out)).otherwise(F.concat(F.upper(F.substring(out, F.lit(1), F.lit(1))), F.substring(out, F.lit(2), F.length(out))))
    return _let(_let(_hash(key, "name", F.concat_ws("/", role, F.lower(word)), attempt), in_script), cased)


def _initial(word: Column, key: str) -> Column:
    return F.concat(F.substring(_name(F.substring(word, 1, 1), F.lit("s"), key, F.lit(0)), 1, 1), F.substring(word, F.lit(2), F.length(word)))


def _words(raw: Column) -> tuple[Column, Column]:
    """Words of a person's mention, and the role of each: t a label, a title or a particle, which stay; i an initial; f or m a given name (the first, and
    listed ones); s a family name (the last, and others)."""
    words = F.split(raw, " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[.:,]$", ""))
    kept, given = [*LABELS, "Dear", *TITLES_F, *TITLES_M, *TITLES_N, *PARTICLES], [*GIVEN_F, *GIVEN_M]
    titled = F.get(bare, F.lit(0)).isin(*TITLES_F, *TITLES_M, *TITLES_N)
    names = F.filter(bare, lambda w: ~w.isin(*kept) & (F.length(w) > 1))
    first = F.get(names, F.lit(0))
    female = F.exists(bare, lambda w: w.isin(*TITLES_F)) | (~F.exists(bare, lambda w: w.isin(*TITLES_M)) & first.isin(*GIVEN_F))
    last = F.size(words) - 1
    own = lambda w: F.when(w.isin(*GIVEN_F), "f").when(w.isin(*GIVEN_M), "m")
    lead = lambda w: F.when(w.isin(*given) & ~titled, own(w)).otherwise(F.when(female, "f").otherwise("m"))
    role = lambda w, i: F.when(w.isin(*kept) & (i < last), "t").when(F.length(w) == 1, "i").when(i == last, "s").when(w == first, lead(w)).otherwise(F.coalesce(own(w), F.lit("s")))
    return words, F.transform(bare, role)


def parts(raw: Column, kind: Column) -> Column:
    """What of a mention is an entity: its normal form; of an address also the domain; of a person each name with its role."""
    one = lambda k, what, of: F.struct(k.alias("kind"), what.alias("what"), of.alias("raw"))
    whole, domain = one(kind, normal(raw, kind), raw), F.lower(F.substring_index(raw, "@", -1))
    words, roles = _words(raw)
    names = F.filter(F.zip_with(words, roles, lambda w, r: one(F.concat(F.lit("name_"), r), F.lower(w), w)), lambda x: ~x["kind"].isin("name_t", "name_i"))
    return F.when(kind == "person", names).when(kind == "email", F.array(whole, one(F.lit("domain"), domain, domain))).otherwise(F.array(whole))


def surrogate(raw: Column, kind: Column, key: str, attempt) -> Column:
    """attempt: gives the attempt of (kind, what)."""
    what = normal(raw, kind)
    n = attempt(kind, what)
    words, roles = _words(raw)
    person = F.array_join(F.zip_with(words, roles, lambda w, r: F.when(r == "t", w).when(r == "i", _initial(w, key)).otherwise(_name(w, r, key, attempt(F.concat(F.lit("name_"), r), F.lower(w))))), " ")
    by_hash = lambda h: (
        F.when(kind == "phone", _phone(raw, what, h, n)).when(kind == "ip", _ip(raw, h, n)).when(kind == "ip6", _ip6(h)).when(kind == "card", _card(raw, h, n)).when(kind == "iban", _iban(raw, h, n))
        .when(kind == "ssn", _digits_into(_longer(raw, n, "0"), _random_digits(F.lit(9) + F.greatest(n - GROW + 1, F.lit(0)), h))).otherwise(_secret(raw, h, n))
    )
    hash_ = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, n.cast("string"), what), 512)
    return F.when(kind == "email", _email(raw, key, attempt)).when(kind == "person", person).otherwise(_let(hash_, by_hash))


def mention(raw: Column) -> Column:
    return F.struct(raw.alias("raw"), kind_of(raw).alias("kind"))


def mentions(text_col: str) -> Column:
    """Array of (raw, kind) of the mentions in a text, in its order."""
    return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), 0), mention)


def text_key(text_col: str) -> Column:
    return F.unhex(F.sha2(F.col(text_col), 256))


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A table of the distinct entities of each text that has any: text (its hash), kind, what (normal form), raw (a spelling)."""
    every = F.array_distinct(F.flatten(F.transform(mentions(text_col), lambda e: parts(e["raw"], e["kind"]))))
    rows = docs.select(F.col(text_col), once(every).alias("e")).where(F.size("e") > 0)
    return materialize(rows.select(text_key(text_col).alias("text"), F.inline("e")), "pii-mentions")


def attempts(mentioned: DataFrame, key: str) -> DataFrame:
    """A table (kind, what, attempt) of the entities that may not keep attempt 0, so that no two entities of a kind have one surrogate and no
    surrogate is an entity. Each round makes and compares only what isn't settled yet."""
    real = materialize(mentioned.groupBy("kind", "what").agg(F.min("raw").alias("raw")), "pii-entities")
    n = F.col("attempt")

    def of(e):
        kind, raw, n = e["kind"], e["raw"], e["n"]
        simple = F.when(kind == "domain", _domain(raw, key, n)).when(kind.startswith("name_"), F.lower(_name(raw, F.substring(kind, -1, 1), key, n)))
        return simple.otherwise(_let(surrogate(raw, kind, key, lambda k, _: F.when(k == kind, n).otherwise(0)), lambda x: normal(x, kind)))

    own = _let(F.struct("kind", "raw", n.alias("n")), of)
    tasks = int(mentioned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending, settled = real.withColumn("attempt", F.lit(0)), []
    while True:
        made = materialize(pending.repartition(tasks, "kind", "what").withColumn("made", own), "pii-made")  # each surrogate is made once, by all executors
        taken = real.select("kind", F.col("what").alias("made"))
        for df in settled:
            taken = taken.unionByName(df.select("kind", "made"))
        again = made.join(taken, ["kind", "made"]).select("kind", "what")
        again = again.unionByName(made.join(made.groupBy("kind", "made").agg(F.min("what").alias("keeper")), ["kind", "made"]).where("keeper <> what").select("kind", "what")).distinct()
        again = materialize(made.join(again, ["kind", "what"], "left_semi").select("kind", "what", "raw", (n + 1).alias("attempt")), "pii-again")
        settled.append(materialize(made.join(again, ["kind", "what"], "left_anti").select("kind", "what", "attempt", "made"), "pii-settled"))
        release(made)
        if again.isEmpty():
            break
        pending = again
    out = settled[0].where("attempt > 0")
    for df in settled[1:]:
        out = out.unionByName(df)
    return materialize(out.select("kind", "what", "attempt"), "pii-attempts")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with every entity of the text column replaced by its surrogate."""
    tag = uuid.uuid4().hex[:8]
    hits, gaps, texts, tries, names = f"__hits_{tag}", f"__gaps_{tag}", f"__text_{tag}", f"__tries_{tag}", f"__names_{tag}"
    mentioned = found(docs, text_col)
    moved = attempts(mentioned, key)
    pair = lambda kind, what: F.concat_ws("\x1f", kind, what)
    # one scan: a mark that depends on the key is set around each mention, and the text is split at it
    mark = F.concat(F.lit("\x1c"), F.substring(F.sha2(F.lit(f"mark\x1f{key}"), 256), 1, 24), F.lit("\x1c"))
    cut = F.split(F.regexp_replace(F.col(text_col), F.lit(PATTERN), F.concat(mark, F.lit("$0"), mark)), mark, -1)
    df = docs.withColumn(gaps, once(cut)).withColumn(hits, once(F.transform(F.filter(F.col(gaps), lambda _, i: i % 2 == 1), mention)))
    if moved.isEmpty():
        attempt = lambda kind, what: F.lit(0)
    else:
        mine = mentioned.select("text", "kind", "what").join(moved, ["kind", "what"]).distinct()
        maps = mine.groupBy(F.col("text").alias(texts)).agg(F.map_from_entries(F.collect_list(F.struct(pair(F.col("kind"), F.col("what")), F.col("attempt")))).alias(tries))
        maps = materialize(maps, "pii-maps")
        small = (maps.agg(F.sum(F.size(tries))).first()[0] or 0) <= MAP_BOUND
        df = df.withColumn(texts, F.when(F.size(hits) > 0, text_key(text_col))).join(F.broadcast(maps) if small else maps, texts, "left")
        attempt = lambda kind, what: F.coalesce(F.try_element_at(F.col(tries), pair(kind, what)), F.lit(0))
    made = F.transform(hits, lambda e: surrogate(e["raw"], e["kind"], key, attempt))
    between = F.filter(F.col(gaps), lambda _, i: i % 2 == 0)
    # names of the text's persons where they stand alone
    people = F.flatten(F.transform(F.filter(hits, lambda e: e["kind"] == "person"), lambda e: parts(e["raw"], e["kind"])))
    known = F.transform(F.array_distinct(people), lambda e: F.struct(e["raw"].alias("word"), _name(e["raw"], F.substring(e["kind"], -1, 1), key, attempt(e["kind"], e["what"])).alias("made")))
    df = df.withColumn(names, once(F.when(F.exists(hits, lambda e: e["kind"] == "person"), known)))
    token = lambda w: F.when(w.rlike(r"^\p{Lu}"), F.coalesce(F.get(F.filter(F.col(names), lambda n: n["word"] == w), F.lit(0))["made"], w)).otherwise(w)
    swap = lambda gap: F.when(F.length(gap) == 0, gap).otherwise(F.array_join(F.transform(F.regexp_extract_all(gap, F.lit(rf"{WORD}|[^\p{{L}}]++"), 0), token), ""))
    between = F.when(F.col(names).isNull(), between).otherwise(F.transform(between, swap))
    new = F.concat(F.get(between, F.lit(0)), F.array_join(F.zip_with(F.slice(between, F.lit(2), F.size(hits)), made, lambda gap, s: F.concat(s, gap)), ""))
    return df.withColumn(text_col, once(F.when(F.size(hits) > 0, new).otherwise(F.col(text_col)))).select(*docs.columns)
