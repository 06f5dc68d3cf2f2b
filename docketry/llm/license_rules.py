"""License scans by ordered signature rules (DataFrame functions only).

A rule is a regular expression over the words of a text. Rules are made of families (a license's name, the
gate words without one of which no rule of the family is tried) and forms (the wording around a name), ordered by
priority: an identifier beats a grant, a grant beats a reference, that beats the bare name; a few rules for
fixed wordings stand alone. One pass over a text looks for any keyword; only texts with one are normalised and
shown to the rules. Detections are word intervals. One that lies within another of the same or a higher
priority is suppressed, so "Apache License" within a grant of it counts once; others stay.

Everything about a text happens in its row: there is no join and no shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from docketry.llm.common import documents

# ---- fixed values -------------------------------------------------------------------------------------------
#: Phrases every scan counts, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: A text without any of these holds no detection; each rule's wording and each base phrase contains one.
KEYWORDS = (
    r"licen[cs]e|spdx|copyright|copyleft|reserved|public domain|warrant|permission|redistribution|proprietary"
    r"|confidential|trademark|(?<![0-9a-z])cc0?(?![0-9a-z])|terms|gpl|apache|creative commons|bsd [234] clause|no attribution|provided as is"
)
#: label, gate, name
FAMILIES = (
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e(?: (?:version |v )?2(?: 0)?)?|apache 2(?: 0)?"),
    ("mit", "mit|expat", r"mit licen[cs]e|expat licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause) bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3 clause) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4 clause) bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("gpl-1.0", "general public|gpl", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| ?v)? ?1(?: 0)?"),
    ("gpl-2.0", "general public|gpl", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| ?v)? ?2(?: 0)?"),
    ("gpl-3.0", "general public|gpl", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| ?v)? ?3(?: 0)?"),
    ("gpl", "general public|gpl", r"gnu (?:general public licen[cs]e|gpl)|gpl licen[cs]e"),
    ("lgpl-2.1", "(?:lesser|library) general public|lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? 2(?: [01])?|lgpl ?v?2(?: [01])?"),
    ("lgpl-3.0", "(?:lesser|library) general public|lgpl", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)?|lgpl ?v?3(?: 0)?"),
    ("lgpl", "(?:lesser|library) general public|lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl"),
    ("agpl-3.0", "affero|agpl", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v )?3(?: 0)?)?|agpl(?: ?v?3(?: 0)?)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: (?:version |v )?1 [123])?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 [01]"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: (?:version |v )?2(?: 0)?)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: (?:version |v )?2(?: 0)?)?"),
    ("eupl", "european", r"european union public licen[cs]e(?: (?:version |v )?1 [012])?"),
    ("cddl", "common", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?: (?:version )?1 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: 2(?: 0)?)?"),
    ("boost-1.0", "boost", r"boost software licen[cs]e(?: (?:version )?1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("php", "php", r"php licen[cs]e(?: (?:version )?3(?: 0?1?)?)?"),
    ("python", "python|psf", r"python software foundation licen[cs]e|psf licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("wtfpl", "public licen", r"do what the f[a-z]+ you want to public licen[cs]e"),
    ("unlicense", "unlicen", r"the unlicen[cs]e|unlicen[cs]e"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: (?:version )?1 [01])?"),
    ("odbl", "database", r"open (?:data commons open )?database licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-3.0", "cc by|creative commons attribution", r"(?:creative commons attribution|cc by) 3 0"),
    ("cc-by-4.0", "cc by|creative commons attribution", r"(?:creative commons attribution|cc by) 4 0"),
    ("cc-by-sa", "cc by|creative commons attribution", r"(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by|creative commons attribution", r"(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by|creative commons attribution", r"(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by|creative commons attribution", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by|creative commons attribution", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: [1-4] [05])?"),
    ("creative-commons", "creative", r"creative commons licen[cs]e"),
)
#: label, published identifier: names too short to stand for a license anywhere
IDENTIFIERS = (
    ("apache-1.1", r"apache 1 1"),
    ("mit", r"mit"),
    ("mit-0", r"mit 0"),
    ("isc", r"isc"),
    ("zlib", r"zlib"),
    ("mpl-1.1", r"mpl ?v?1 [01]"),
    ("mpl-2.0", r"mpl ?v?2 0"),
    ("epl-1.0", r"epl ?v?1 0"),
    ("epl-2.0", r"epl ?v?2 0"),
    ("eupl", r"eupl ?v?1 [012]"),
    ("cddl", r"cddl ?v?1 [01]"),
    ("cpl-1.0", r"cpl ?v?1 0"),
    ("artistic-2.0", r"artistic 2 0"),
    ("boost-1.0", r"bsl 1 0"),
    ("openssl", r"openssl"),
    ("php", r"php 3 0?1?"),
    ("python", r"psf 2 0|python 2 0"),
    ("ruby", r"ruby"),
    ("wtfpl", r"wtfpl"),
    ("ofl-1.1", r"ofl ?v?1 [01]"),
    ("odbl", r"odbl ?v?1 0"),
    ("postgresql", r"postgresql"),
    ("ms-pl", r"ms pl"),
    ("ms-rl", r"ms rl"),
    ("gfdl", r"gfdl ?v?1 [123]"),
)
#: The wording before identifiers, with priority and confidence; one of them is a gate to all.
IDENTIFIER_FORMS = (
    (r"spdx licen[cs]e identifier ", 1, 1.0),
    (r"(?:licen[cs]ed|released|distributed) under (?:either )?(?:the )?(?:terms of )?(?:the )?", 2, 0.95),
)
#: wording before a name, after it, priority (the smallest is the highest), confidence
FORMS = (
    (r"spdx licen[cs]e identifier ", "", 1, 1.0),
    (
        r"(?:(?:is|are|was|were) )?(?:dual )?(?:licen[cs]ed|released|distributed|published|available|provided|offered) under "
        r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:an? )?",
        "(?: licen[cs]e)?",
        2,
        0.95,
    ),
    (r"(?:subject to|governed by|covered by|in accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", "", 3, 0.85),
    (r"(?:see|read|accept|agree to|a copy of|compatible with) (?:the )?(?:full )?(?:text of )?(?:the )?", "(?: for details)?", 4, 0.7),
    ("", "", 5, 0.6),
)
#: label, gate, wording, priority, confidence
SINGLE = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 2, 0.95),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 2, 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 2, 0.9),
    ("copyleft", "copyleft", r"copyleft", 5, 0.4),
    ("no-warranty", "warrant|provided as is", r"(?:without (?:any )?warrant(?:y|ies)(?: of any kind)?|provided as is|comes with absolutely no warranty)", 5, 0.4),
    ("public-domain", "domain", r"(?:released into|placed in|dedicated to|in) the public domain", 3, 0.8),
    ("copyright", "copyright", r"(?:copyright (?:c )?(?:19|20)[0-9]{2}|c copyright|copyright (?:by|c))(?: [0-9]{4})*", 5, 0.5),
    ("reserved", "reserved", r"(?:copyright (?:c )?(?:[0-9]{4} )?)?all rights reserved", 4, 0.5),
    ("reserved", "reserved", r"(?:some|no) rights reserved", 4, 0.5),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|software|information|licen[cs]e)", 3, 0.8),
    ("confidential", "confidential", r"confidential (?:and proprietary|information)", 4, 0.6),
    ("trademark", "trademark", r"(?:is a|are) (?:registered )?trademarks? of", 5, 0.3),
    ("no-redistribution", "permission", r"(?:without|requires) (?:the )?(?:prior )?(?:express )?(?:written )?permission", 4, 0.5),
    ("terms-of-use", "terms", r"terms (?:of use|of service|and conditions of use) apply", 4, 0.4),
)
# ---- end of fixed values ------------------------------------------------------------------------------------

#: A base phrase that no rule confirms.
BASE_CONFIDENCE = 0.5
WORD_RUN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
OTHER_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = "struct<first:int,end:int,priority:int,label:string,confidence:double>"
LOWEST = max(f[2] for f in (*FORMS,))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def structs(rows, *names: str) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])


def count_words(text: Column) -> Column:
    """Words of a piece of normalised text."""
    return bind(F.trim(text), lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, " "))))


def spans(normal: Column, regex: Column, priority: Column, label: Column, confidence: Column) -> Column:
    """All word intervals that a rule matches, left to right, from what stands between the matches."""
    empty = F.array().cast(f"array<{SPAN}>")

    def walk(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

        def step(state: Column, k: Column) -> Column:
            first = state["at"] + count_words(F.get(found["between"], k))
            ends = bind(
                first, lambda a: F.struct(a.alias("first"), (a + count_words(F.get(found["matches"], k))).alias("end"))
            )
            return bind(
                ends,
                lambda e: F.struct(
                    e["end"].alias("at"),
                    F.array_append(
                        state["spans"],
                        F.struct(
                            e["first"].alias("first"),
                            e["end"].alias("end"),
                            priority.alias("priority"),
                            label.alias("label"),
                            confidence.alias("confidence"),
                        ),
                    ).alias("spans"),
                ),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(found["matches"]) - 1), start, step)["spans"]

    pieces = F.struct(
        F.regexp_extract_all(normal, regex, F.lit(0)).alias("matches"), F.split(normal, regex, -1).alias("between")
    )
    return bind(regex, lambda r: F.when(F.rlike(normal, r), bind(pieces, walk)).otherwise(empty))


def detections(normal: Column) -> Column:
    """All spans of all rules whose gate is in the text."""
    names = structs(IDENTIFIERS, "label", "name")
    identifier_forms = structs(IDENTIFIER_FORMS, "before", "priority", "confidence")
    forms = structs(FORMS, "before", "after", "priority", "confidence")
    families = structs(FAMILIES, "label", "gate", "name")
    single = structs(SINGLE, "label", "gate", "wording", "priority", "confidence")
    open_families = F.filter(families, lambda f: F.rlike(normal, f["gate"]))
    whole = lambda *parts: F.concat(F.lit("(?<= )"), *parts, F.lit("(?= )"))

    def by_form(family: Column) -> Column:
        def one(form: Column) -> Column:
            regex = whole(form["before"], F.lit("(?:"), family["name"], F.lit(")"), form["after"])
            return spans(normal, regex, form["priority"], family["label"], form["confidence"])

        # the bare name first: without it none of its forms can match
        named = F.rlike(normal, whole(F.lit("(?:"), family["name"], F.lit(")")))
        return F.when(named, F.flatten(F.transform(forms, one))).otherwise(F.array().cast(f"array<{SPAN}>"))

    def alone(rule: Column) -> Column:
        return spans(normal, whole(F.lit("(?:"), rule["wording"], F.lit(")")), rule["priority"], rule["label"], rule["confidence"])

    def identified(form: Column) -> Column:
        def one(name: Column) -> Column:
            regex = whole(form["before"], F.lit("(?:"), name["name"], F.lit(")(?: or later| only| licen[cs]e)?"))
            return spans(normal, regex, form["priority"], name["label"], form["confidence"])

        return F.when(F.rlike(normal, form["before"]), F.flatten(F.transform(names, one))).otherwise(F.array().cast(f"array<{SPAN}>"))

    open_single = F.filter(single, lambda r: F.rlike(normal, r["gate"]))
    return F.concat(
        F.flatten(F.transform(open_families, by_form)),
        F.flatten(F.transform(open_single, alone)),
        F.flatten(F.transform(identifier_forms, identified)),
    )


def unsuppressed(found: Column) -> Column:
    """The spans that no other span of the same or a higher priority contains.

    In order of first word and descending end whatever contains a span stands before it, so one fold with
    the greatest end per priority is enough. Of equal intervals the first in order of priority and label stays.
    """
    order = F.sort_array(
        F.transform(found, lambda s: F.struct(s["first"], (-s["end"]).alias("minus"), s["priority"], s["label"], s["confidence"]))
    )
    start = F.struct(
        F.array_repeat(F.lit(-1), LOWEST).alias("ends"), F.array().cast(f"array<{SPAN}>").alias("kept")
    )

    def step(state: Column, s: Column) -> Column:
        end = -s["minus"]
        contained = F.exists(F.slice(state["ends"], F.lit(1), s["priority"]), lambda e: e >= end)
        raised = F.transform(
            state["ends"], lambda e, p: F.when(p + 1 == s["priority"], F.greatest(e, end)).otherwise(e)
        )
        span = F.struct(s["first"].alias("first"), end.alias("end"), s["priority"].alias("priority"), s["label"].alias("label"), s["confidence"].alias("confidence"))
        return F.struct(
            raised.alias("ends"),
            F.when(contained, state["kept"]).otherwise(F.array_append(state["kept"], span)).alias("kept"),
        )

    return F.aggregate(order, start, step)["kept"]


def base_places(words: Column) -> Column:
    """(place, label) of every base phrase, wherever its words stand one after the other."""

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        last = F.size(words) - len(parts)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

        def stands(i: Column) -> Column:
            here = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                here = here & (F.get(words, i + k) == part)
            return here

        return F.transform(F.filter(starts, stands), lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))

    return F.concat(*[places(*b) for b in BASE])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, spans) for every row of ``docs``.

    ``base`` lists (place, label) of the base phrases, ``spans`` the detections that are not suppressed, as
    (first, end, priority, label, confidence) in words from 0. Null and empty texts have no words and empty
    lists. Rows are handled one by one, so null doc_ids, repeated rows and other columns make no difference;
    the work for a text grows with its length and its detections. An empty table gives an empty result.
    """
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    normal = F.trim(F.regexp_replace(lowered, OTHER_RUN, " "))

    def found(text: Column) -> Column:
        return F.struct(
            bind(F.split(text, " "), base_places).alias("base"),
            unsuppressed(detections(F.concat(F.lit(" "), text, F.lit(" ")))).alias("spans"),
        )

    nothing = F.struct(
        F.array().cast("array<struct<place:int,label:string>>").alias("base"),
        F.array().cast(f"array<{SPAN}>").alias("spans"),
    )
    any_keyword = F.col("text").rlike("(?i)" + KEYWORDS.replace(" ", OTHER_RUN))
    return documents(docs).select(
        "doc_id",
        F.regexp_count("text", F.lit(WORD_RUN)).cast("long").alias("n_words"),
        F.when(any_keyword, bind(normal, found)).otherwise(nothing).alias("found"),
    ).select("doc_id", "n_words", "found.base", "found.spans")


def summary(scanned: DataFrame) -> DataFrame:
    """The scan as counts, first and last base place, labels and a score (the best confidence, 0 for none)."""
    places = F.transform("base", lambda b: b["place"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("spans", lambda s: s["label"]))))
    best = F.array_max(F.transform("spans", lambda s: s["confidence"]))
    score = F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
