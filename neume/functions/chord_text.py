"""Chord text: normal form, grammar, recogniser look-alikes, and parsing into components.

Everything is Column -> Column; rule tables are data, applied by ``rewrite``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from neume.functions.rewrite import all_rules, first_rule, let, swaps

# --- fixed values: signs, look-alikes and word lists of chord notation -------------------------------

#: Signs of printed chords and of music fonts, and what they are written as.
SIGNS = {"♭": "b", "♯": "#", "△": "maj7", "°": "dim", "ø": "m7b5", "": "b", "": "#", "": "b", "": "#", "–": "-"}
CHORD = r"^[A-G][#b♭♯]?(maj|min|dim|aug|sus|add|△|m|M)?[0-9()#b♭♯ø°+\-/△]*(/[A-G][#b♭♯]?)?$"
ROOT_LOOKALIKES = {"0": "G", "6": "G", "8": "B", "1": "I", "4": "D", "9": "G"}
ACCIDENTAL_LOOKALIKES = {"h": "b", "q": "b", "n": "b", "o": "b", "f": "#", "c": "#"}
BODY_LOOKALIKES = {"?": "7", '"': "7", "'": "7", "h": "b", "q": "b", "f": "#", "c": "#", "z": "7", "Z": "7"}
SUFFIXES = (
    "", "5", "6", "7", "9", "11", "13", "m", "m6", "m7", "m9", "m11", "m13", "-", "-6", "-7", "-9", "-11", "-13", "maj", "maj6", "maj7", "maj9", "maj13",
    "dim", "dim7", "aug", "+", "+7", "sus", "sus2", "sus4", "7sus", "7sus4", "9sus", "9sus4", "add9", "6/9", "m7b5", "7b5", "7#5", "7b9", "7#9", "13b9", "alt",
)
#: Chart symbols: signs with a seven first, then single signs.
CHART_SIGNS = {
    "ø7": "m7b5", "△7": "maj7", "∆7": "maj7", "Δ7": "maj7", "♭": "b", "": "b", "": "b", "♯": "#", "": "#", "": "#",
    "△": "maj7", "∆": "maj7", "Δ": "maj7", "ø": "m7b5", "°": "dim", "−": "-", "–": "-", "—": "-",
}
#: What whole chart tokens are misread for.
CHART_TOKENS = (("^0713$", "D7b13"), ("^0D7h3$", "D7b13"), ("^0D113$", "D7b13"), ("^D113$", "D7b13"), ("^6719$", "G7b9"), ("^6z$", "G7"), ("^9z$", "G7"))
#: What the rest of a chart token after its root (1) and accidental (2) is misread for; the first that fits holds.
CHART_BODIES = (
    ("(?i)^([A-G][#b])(z|az|a7|lz|l7)$", "$1maj7"),
    ("(?i)^B(zz|4z)$", "Bbmaj7"),
    ("(?i)^([A-G])(az|a7|lz|l7)$", "$1bmaj7"),
    ("(?i)^A(zz|oz)$", "Am7b5"),
    ("(?i)^Eoz$", "Edim7"),
    ("(?i)^Bs$", "Bb6"),
    ("(?i)^([A-G])[hqnp]z$", "$1bmaj7"),
    ("(?i)^([A-G])[hqnp]$", "$1b"),
    ("(?i)^([AB])z$", "$1b7"),
    ("(?i)^([A-G][#b]?)(7s|75|z5)$", "$17#5"),
    ("(?i)^([A-G][#b]?)(c|c7)$", "$1maj7"),
    ("(?i)^Ad7$", "Am7b5"),
    ("^([A-G][#b]?)719$", "$17b9"),
    ("(?i)^([A-G][#b]?)(7b1z|7h3|713|7113|7l13|7i13)$", "$17b13"),
    ("^([A-G][#b]?)[\\[({|]*76(5|9|11|13)[\\])}|]*$", "$17b$2"),
)
#: Suffix fragments read on their own.
SUFFIX_TEXT = (
    ("^(ø|ø7)$", "m7b5"),
    ("^(°|o|O|0)$", "dim"),
    ("^(°7|o7|O7|07)$", "dim7"),
    ("^(△|∆|Δ)7?$", "maj7"),
    ("^(77|777)$", "7"),
    ("^76(5|9|11|13)$", "7b$1"),
    ("^7[1lI]9$", "7b9"),
    ("^74(5|9|11|13)$", "7#$1"),
    ("^7(1|l|I|11|l1|I1)3$", "7b13"),
    ("^[3)]?7[6bB]13$", "7b13"),
    ("^3711$", "7b13"),
)
BODY = r"^(mMaj|maj|m|dim|aug|sus|add|alt)?[0-9#b()+-]*$"

# --- sheet-music text ---------------------------------------------------------------------------------


def normal_text(text: Column) -> Column:
    """Trimmed, with the signs of chord printing and music fonts written out; null gives the empty string."""
    return swaps(F.trim(F.coalesce(text, F.lit(""))), SIGNS)


def is_chord(text: Column) -> Column:
    """Whether the text is a chord symbol: at most 16 characters, no blank but round a slash."""
    token = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s*/\s*", "/")
    return let(token, lambda t: (F.length(t) <= 16) & ~t.contains(" ") & t.rlike(CHORD))


def _char_map(char: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), char), char)


def canonical_case(text: Column) -> Column:
    """Body in lower case with ``M`` as maj, and a capital bass."""
    return let(text, _canonical_case)


def _canonical_case(text: Column) -> Column:
    main, bass = F.regexp_extract(text, r"(?s)^([^/]*)", 1), F.regexp_extract(text, r"(?s)^[^/]*/(.*)$", 1)
    root = F.regexp_extract(main, r"(?s)^(.[#b]?)", 1)
    body = F.lower(F.regexp_replace(F.regexp_replace(F.substr(main, F.length(root) + 1), "^(?i)maj", "maj"), "^M", "maj"))
    low = F.concat(F.upper(F.substring(bass, 1, 1)), F.lower(F.substr(bass, F.lit(2))))
    return F.concat(root, body, F.when(text.contains("/"), F.concat(F.lit("/"), low)).otherwise(""))


def corrected(text: Column) -> Column:
    """A recogniser's reading with digits and letters that look like chord signs put right, place by place."""
    token = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", "")
    token = F.regexp_replace(F.replace(token, F.lit("_"), F.lit("-")), r"[.,;:!|]+$", "")
    return let(F.regexp_replace(token, "(?i)inaj", "maj"), _mended)


def _mended(token: Column) -> Column:
    first = F.upper(F.substring(token, 1, 1))
    second = F.substring(token, 2, 1)
    fixed = _char_map(second, ACCIDENTAL_LOOKALIKES)
    has_accidental = second.isin("#", "b", "♭", "♯", *ACCIDENTAL_LOOKALIKES)
    head = F.concat(_char_map(first, ROOT_LOOKALIKES), F.when(has_accidental, fixed).otherwise(""))
    rest = F.substr(token, F.when(has_accidental, 3).otherwise(2))
    chars = F.split(F.when(rest == "", None).otherwise(rest), "")
    last = F.size(chars) - 1

    def mend(c: Column, i: Column) -> Column:
        # a five after a flat; what counts is the flat as mended one place before
        flat_before = (i > 0) & _char_map(F.get(chars, i - 1), BODY_LOOKALIKES).isin("b")
        return F.when(c.isin("a", "A"), F.when(i == last, "△").otherwise(c)).when(c.isin("s", "S") & flat_before, "5").otherwise(_char_map(c, BODY_LOOKALIKES))

    body = F.coalesce(F.array_join(F.transform(chars, mend), ""), F.lit(""))
    whole = canonical_case(F.regexp_replace(F.concat(head, body), "mn7$", "m7"))
    digit_bass = lambda w: F.regexp_extract(w, "/([0-9])", 1)
    mended = lambda w: F.when(digit_bass(w) != "", F.regexp_replace(w, "/[0-9]", F.concat(F.lit("/"), _char_map(digit_bass(w), ROOT_LOOKALIKES)))).otherwise(w)
    return F.when(token == "", "").otherwise(let(whole, mended))


def chord_root(text: Column) -> Column:
    return F.regexp_extract(text, "^([A-G][#b]?)", 1)


def is_common_chord(text: Column) -> Column:
    """Root and one of the common suffixes."""
    return let(normal_text(text), _is_common_chord)


def _is_common_chord(t: Column) -> Column:
    root = chord_root(t)
    return (root != "") & F.substr(t, F.length(root) + 1).isin(*SUFFIXES)


def is_suspicious(text: Column) -> Column:
    """An accepted chord that isn't a common one, or has unbalanced parentheses."""
    return let(normal_text(text), _is_suspicious)


def _is_suspicious(t: Column) -> Column:
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (t != "") & ((count("(") != count(")")) | ~_is_common_chord(t))


def high_risk(text: Column) -> Column:
    """Texts whose body is a known misreading, ends in an unopened parenthesis or in a lone one."""
    return let(normal_text(text), _high_risk)


def _high_risk(t: Column) -> Column:
    body = F.substr(t, F.length(chord_root(t)) + 1)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (t != "") & ((count("(") != count(")")) | body.isin("19", "79", "69", "761", "769") | (t.endswith(")") & ~t.contains("(")) | (body.endswith("1") & ~body.isin("11", "m11", "-11", "maj11")))


def root_only(text: Column) -> Column:
    return normal_text(text).rlike("^[A-G][#b]?$")


# --- chord charts -------------------------------------------------------------------------------------


def chart_compact(text: Column) -> Column:
    """Signs written out, blanks gone, and whole-token misreadings put right."""
    t = swaps(F.trim(F.coalesce(text, F.lit(""))), CHART_SIGNS)
    t = all_rules(t, ((r"\s*/\s*", "/"), (r"\s+", ""), (r"^[.,;:!|]+|[.,;:!|]+$", "")))
    t = all_rules(t, ((r"^[|Il\[]+(?=[A-Ga-g])", ""), (";", "#"), ("[vV]", "b"), ("^[0O](?=[Dd])", "")))
    return let(first_rule(t, ((r"^N([-−–—mM]?[0-9#b()+-]*)$", "A$1"),)), _chart_token)


def _chart_token(t: Column) -> Column:
    token = first_rule(t, CHART_TOKENS, otherwise=F.lit(None).cast("string"))
    rooted = all_rules(t, (("^[69](?=.)", "G"), ("^8(?=.)", "B")))
    upper = lambda x: F.when(x.rlike("^[a-g]"), F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))).otherwise(x)
    return F.coalesce(token, let(let(rooted, upper), _chart_body))


def _chart_body(t: Column) -> Column:
    flat_tail = F.concat(F.substring(t, 1, 1), F.lit("b"), F.regexp_replace(F.substr(t, F.lit(3)), "[zZ]", "7"))
    sevens = F.regexp_replace(F.substr(t, F.lit(2)), "[zZ]", "7")
    plain = F.concat(F.substring(t, 1, 1), all_rules(sevens, (("^([#b]?)719$", "$17b9"), ("7b1[37]", "7b13"))))
    return first_rule(t, CHART_BODIES, otherwise=F.when(t.rlike("^[A-G][hqnpHQNP].+"), flat_tail).when(t.rlike("^[A-G]"), plain).otherwise(t))


def _canonical_body(body: Column) -> Column:
    """The body in canonical spelling; null if letters stand in it that no quality begins with."""
    b = first_rule(body, (("(?i)^min", "m"), ("^-", "m"), ("^[mM](?![aA][jJ])", "m"), ("(?i)^maj", "maj"), ("^[oO0]", "dim")))
    b = first_rule(b, (("(?i)^mmaj$", "mMaj7"), ("(?i)^mmaj", "mMaj"), ("(?i)^maj$", "maj7"), ("(?i)^m7b5$", "m7b5"), ("(?i)^sus", "sus"), ("(?i)^add", "add")))
    return let(b, lambda x: F.when(x.rlike(BODY), x))


def chord_quality(body: Column) -> Column:
    """Quality by how a canonical body begins."""
    begins = (("mMaj", "minor_major"), ("m7b5", "half_diminished"), ("maj", "major"), ("m", "minor"), ("dim", "diminished"), ("aug", "augmented"), ("sus", "suspended"), ("add", "added_tone"), ("alt", "altered"))
    out = F.when(body == "", "major")
    for start, quality in begins:
        out = out.when(body.startswith(start), quality)
    return out.when(body.rlike("^[0-9]"), "dominant")


def parse_chord(text: Column) -> Column:
    """struct(text_raw, text_norm, root, accidental, quality, extensions, alterations, bass); null if not a chord."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    return let(F.struct(raw.alias("raw"), chart_compact(raw).alias("token")), _parse)


def _parse(read: Column) -> Column:
    raw, token = read["raw"], read["token"]
    split = token.rlike("^.+/[^/]+$")
    main = F.when(split, F.regexp_extract(token, "^(.+)/[^/]+$", 1)).otherwise(token)
    bass = F.when(split, chart_compact(F.regexp_extract(token, "^.+/([^/]+)$", 1)))
    rest = F.substr(main, F.length(F.regexp_extract(main, "^([A-G][#b]?)", 1)) + 1)
    parts = F.struct(
        F.regexp_extract(main, "^([A-G])", 1).alias("root"),
        F.regexp_extract(main, "^[A-G]([#b]?)", 1).alias("accidental"),
        _canonical_body(rest).alias("body"),
        let(bass, lambda b: F.when(b.rlike("^[A-G][#b]?$"), b)).alias("bass"),
    )

    def built(p: Column) -> Column:
        fine = (raw != "") & (F.length(token) <= 24) & (p["root"] != "") & p["body"].isNotNull() & (~split | p["bass"].isNotNull())
        norm = F.concat(p["root"], p["accidental"], p["body"], F.when(p["bass"].isNotNull(), F.concat(F.lit("/"), p["bass"])).otherwise(""))
        degrees = lambda pattern: F.regexp_extract_all(p["body"], F.lit(pattern), F.lit(1))
        chord = F.struct(
            raw.alias("text_raw"),
            norm.alias("text_norm"),
            p["root"].alias("root"),
            F.when(p["accidental"] != "", p["accidental"]).alias("accidental"),
            chord_quality(p["body"]).alias("quality"),
            degrees("((?<![#b])(?:6|7|9|11|13))").alias("extensions"),
            degrees("([#b](?:5|9|11|13))").alias("alterations"),
            p["bass"].alias("bass"),
        )
        return F.when(fine, chord)

    return let(parts, built)


def numeric_flat_suffix(text: Column) -> Column:
    """``76`` and a degree is a seventh with that degree flat; null otherwise."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), r"^[\[\](){}|]+|[\[\](){}|]+$", "")
    return let(t, lambda x: F.when(x.rlike("^76(5|9|11|13)$"), F.regexp_replace(x, "^76", "7b")))


def suffix_body(text: Column) -> Column:
    """The chord body that a suffix fragment stands for; null if it stands for none."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), r"^[.,;:!|\[\](){}]+|[.,;:!|\[\](){}]+$", "")
    return let(t, _suffix_body)


def _suffix_body(t: Column) -> Column:
    known = first_rule(t, SUFFIX_TEXT, otherwise=F.lit(None).cast("string"))
    parsed = parse_chord(t)
    of_chord = F.regexp_replace(F.regexp_extract(parsed["text_norm"], "^([^/]*)", 1), "^[A-G][#b]?", "")
    loose = all_rules(swaps(t, CHART_SIGNS), ((";", "#"), ("[zZ]", "7"), ("[vV]", "b"), ("^-", "m"), ("(?i)^min", "m"), ("^M", "maj")))
    empty = (t == "") | t.isin("b", "B", "#", "♭", "♯")
    number = t.rlike("^[0-9]+$") & ~t.isin("6", "7", "9", "11", "13")
    return F.when(empty, None).otherwise(F.coalesce(known, F.when(~number, F.coalesce(of_chord, let(loose, lambda x: F.when(x.rlike(BODY), x))))))


def accidental_of(text: Column) -> Column:
    """Sharp or flat among a fragment's look-alikes; flat if both."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return F.when(t.rlike("[bBvVhHpPnN6♭]"), "b").when(t.rlike("[#♯]"), "#")


def merged_body(root_body: Column, suffix: Column) -> Column:
    """The body of a root's own reading and a suffix's together; the more specific wins."""
    longer = F.when(F.length(suffix) > F.length(root_body), suffix).otherwise(root_body)
    return (
        F.when(suffix.isNull(), root_body)
        .when((root_body == "") | suffix.startswith(root_body), suffix)
        .when(root_body.startswith(suffix), root_body)
        .when((root_body == "7") & suffix.rlike("^[b#]"), F.concat(F.lit("7"), suffix))
        .otherwise(longer)
    )


def combined_suffixes(bodies: Column) -> Column:
    """One body from an array of suffix bodies: a quality first, then the longest altered seventh, then the longest."""
    quality = F.get(F.filter(bodies, lambda b: b.rlike("^(m|maj|dim|aug|sus|add|alt)")), 0)
    longest = lambda xs: F.get(F.array_sort(xs, lambda x, y: F.length(y) - F.length(x)), 0)
    altered = F.filter(bodies, lambda b: b.rlike("^7([#b](5|9|11|13))+$"))
    degrees = F.filter(bodies, lambda b: b.rlike("^[#b](5|9|11|13)$"))
    seven = F.concat(F.lit("7"), F.array_join(degrees, ""))
    return F.when(F.size(bodies) == 0, None).when(quality.isNotNull(), quality).when(F.size(altered) > 0, longest(altered)).when(F.array_contains(bodies, "7"), seven).otherwise(longest(bodies))


# --- flow, repeats and headers ------------------------------------------------------------------------


def navigation(text: Column) -> Column:
    """Navigation kind of a token: fine, dc, dc_al_fine, dc_al_coda, dc_al_ending, ds..., coda, segno; else null."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\s.]+", "")
    out = F.when(t.rlike("^fine$"), "fine")
    for sign, name in (("dc", "dc"), ("ds", "ds")):
        out = out.when(t.rlike(f"^{sign}al[0-9]+(st|nd|rd|th)?ending$"), f"{name}_al_ending").when(t.rlike(f"^{sign}alfine$"), f"{name}_al_fine").when(t.rlike(f"^{sign}alcoda$"), f"{name}_al_coda").when(t.rlike(f"^{sign}$"), name)
    return out.when(t.rlike("^coda$"), "coda").when(t.rlike("^segno$"), "segno")


def ending_number(text: Column) -> Column:
    """The number of an ending mark such as ``1.``; else null."""
    return F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"^([1-9])\.$", 1).try_cast("int")


def is_repeat(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).isin("%", "./.", ".|.", "𝄎")


def slash_bass(text: Column) -> Column:
    """The bass root of a lone ``/X``; else null."""
    bass = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), "^/([A-Ga-g][#b]?)$", 1)
    return F.when(bass != "", F.concat(F.upper(F.substring(bass, 1, 1)), F.substr(bass, F.lit(2))))


def time_signature(text: Column) -> Column:
    """struct(beats, unit) from the first and the last digit only, so that 12/8 reads as 1/8."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 2, F.struct(F.substring(digits, 1, 1).cast("int").alias("beats"), F.substring(digits, -1, 1).cast("int").alias("unit")))


def safe_name(text: Column) -> Column:
    """A file name of letters, digits, dot, dash and underscore."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
