"""Licence scans by sentence rules.

A text is cut into parts (at line ends and after ``. ; ! ?`` with a space).
Parts are normalised: lower case, everything but ASCII letters, digits and
inner dots becomes one space, which takes comment signs away. A known sentence
fills one part or several that follow each other over line ends or semicolons,
so wrapped lines do no harm; it does not reach over blank lines (also those of
a comment) or over the end of a sentence (``. ! ?``). Of the known sentences
that start at a part the longest counts; each has an identifier.
The identifiers of a text, in order, are
matched against ordered rules: a rule matches if its identifiers follow each
other in the sequence (unknown sentences in between do not count). The first
rule that matches gives the licence; the licences of all matching rules are
listed in rule order. Identifiers that are known but that no rule explains
give the licence ``unclear``.

Templates are sentences with open slots: ``*`` stands for 1 to 12 words (an
owner, a project, where to read on), ``(a|b)`` for one of some words. A slot at
the start stays on its line; one inside also reaches over the dot of an owner
such as ``Inc.``. Texts without a word of any sentence or template (``cue``) are
not cut.

The sentence and rule tables are parameters of fixed size and are compared in
expressions (the sentences as one regular expression). The DuckDB twin knows
sentences and templates within one part only, so it has no wrapped ones. Only built-in functions, one narrow pass, no shuffle. Whole texts
are read. Null and empty texts have no sentence. A row in gives a row out.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import pin

# Known sentences of public licences (normalised) and identifiers.
SENTENCES = {
    "released under the mit license": "MIT_REF",
    "licensed under the mit license": "MIT_REF",
    "this software is released under the mit license": "MIT_REF",
    "permission is hereby granted free of charge to any person obtaining a copy of this software"
    " and associated documentation files the software to deal in the software without restriction"
    : "MIT_GRANT_SHORT",
    "the above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied": "AS_IS",
    "licensed under the apache license version 2.0": "APACHE2_REF",
    "licensed under the apache license version 2.0 the license": "APACHE2_REF",
    "you may not use this file except in compliance with the license": "APACHE_COMPLY",
    "you may obtain a copy of the license at": "APACHE_COPY",
    "this work is licensed under the gnu general public license version 3": "GPL3_REF",
    "this program is licensed under the gnu general public license version 3": "GPL3_REF",
    "this work is licensed under the gnu general public license version 2": "GPL2_REF",
    "this program is free software you can redistribute it and or modify it under the terms of the"
    " gnu general public license": "GPL_GRANT",
    "licensed under cc by 4.0": "CCBY_REF",
    "licensed under cc by sa 4.0": "CCBYSA_REF",
    "licensed under cc by nc 4.0": "CCBYNC_REF",
    "licensed under cc by nc nd 4.0": "CCBYNCND_REF",
    "licensed under cc0 1.0": "CC0_REF",
    "redistribution and use in source and binary forms with or without modification are permitted"
    " provided that the following conditions are met": "BSD_GRANT",
    "neither the name of the copyright holder nor the names of its contributors may be used to"
    " endorse or promote products derived from this software without specific prior written"
    " permission": "BSD_ENDORSE",
    "all rights reserved": "ARR",
}
# The same sentences in the full wording of the public texts.
SENTENCES |= {
    "permission is hereby granted free of charge to any person obtaining a copy of this software"
    " and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense"
    " and or sell copies of the software and to permit persons to whom the software is furnished to"
    " do so subject to the following conditions": "MIT_GRANT_SHORT",
    "the above copyright notice and this permission notice including the next paragraph shall be"
    " included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but"
    " not limited to the warranties of merchantability fitness for a particular purpose and"
    " noninfringement": "AS_IS",
    "apache license version 2.0 january 2004": "APACHE2_REF",
    "the asf licenses this file to you under the apache license version 2.0 the license": "APACHE2_REF",
    "gnu general public license version 3 29 june 2007": "GPL3_REF",
    "gnu general public license version 2 june 1991": "GPL2_REF",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3_REF",
    "gnu lesser general public license version 2.1 february 1999": "LGPL21_REF",
    "gnu affero general public license version 3 19 november 2007": "AGPL3_REF",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2_REF",
    "permission to use copy modify and or distribute this software for any purpose with or without"
    " fee is hereby granted provided that the above copyright notice and this permission notice"
    " appear in all copies": "ISC_GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without"
    " fee is hereby granted provided that the above copyright notice and this permission notice"
    " appear in all copies": "ISC_GRANT",
}
for _place in ("http www.apache.org licenses license 2.0", "https www.apache.org licenses license 2.0"):
    SENTENCES["you may obtain a copy of the license at " + _place] = "APACHE_COPY"
for _owner in ("the copyright holders", "the copyright owner", "the author", "the authors", "the project",
               "the organization", "the university", "the company"):
    SENTENCES[f"neither the name of {_owner} nor the names of its contributors may be used to endorse or"
              " promote products derived from this software without specific prior written"
              " permission"] = "BSD_ENDORSE"
for _what in ("this program", "this library", "this file", "this software", "this package", "it", "foobar"):
    for _name, _version, _ident in (
            ("", "3", "GPL3_REF"), ("", "2", "GPL2_REF"), ("lesser ", "3", "LGPL3_REF"),
            ("lesser ", "2.1", "LGPL21_REF"), ("affero ", "3", "AGPL3_REF")):
        _grant = (f"{_what} is free software you can redistribute it and or modify it under the terms of the gnu"
                  f" {_name}general public license")
        SENTENCES[f"{_grant} as published by the free software foundation either version {_version} of the"
                  " license or at your option any later version"] = _ident
        SENTENCES[f"{_grant} as published by the free software foundation version {_version}"] = _ident
        SENTENCES[f"{_grant} as published by the free software foundation version {_version} of the"
                  " license"] = _ident
        SENTENCES[f"{_grant} version {_version} as published by the free software foundation"] = _ident
for _kind, _ident in (("attribution", "CCBY_REF"), ("attribution sharealike", "CCBYSA_REF"),
                      ("attribution noncommercial", "CCBYNC_REF"),
                      ("attribution noncommercial noderivatives", "CCBYNCND_REF")):
    for _the in ("a", "the"):
        SENTENCES[f"this work is licensed under {_the} creative commons {_kind} 4.0 international license"] = _ident
# Tags of one line, and the names that files give to a licence.
for _tag, _ident in (("mit", "MIT_REF"), ("apache 2.0", "APACHE2_REF"), ("bsd 3 clause", "BSD3_REF"),
                     ("bsd 2 clause", "BSD2_REF"), ("isc", "ISC_REF"), ("mpl 2.0", "MPL2_REF"),
                     ("cc by 4.0", "CCBY_REF"), ("cc by sa 4.0", "CCBYSA_REF"), ("cc by nc 4.0", "CCBYNC_REF"),
                     ("cc by nc nd 4.0", "CCBYNCND_REF"), ("cc0 1.0", "CC0_REF")):
    SENTENCES[f"spdx license identifier {_tag}"] = _ident
for _tag, _ident in (("gpl 3.0", "GPL3_REF"), ("gpl 2.0", "GPL2_REF"), ("agpl 3.0", "AGPL3_REF"),
                     ("lgpl 3.0", "LGPL3_REF"), ("lgpl 2.1", "LGPL21_REF")):
    for _more in ("", " only", " or later"):
        SENTENCES[f"spdx license identifier {_tag}{_more}"] = _ident
SENTENCES["licensed under the mit license the license"] = "MIT_REF"
TEMPLATES = {
    "neither the (name|names) of * nor the names of (its|their) contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission": "BSD_ENDORSE",
}
for _name, _ident in (("mit license", "MIT_REF"), ("apache license (version|v) 2.0", "APACHE2_REF"),
                      ("apache (2.0 license|license 2.0)", "APACHE2_REF"), ("bsd 3 clause license", "BSD3_REF"),
                      ("bsd 2 clause license", "BSD2_REF"), ("isc license", "ISC_REF"),
                      ("mozilla public license (version|v) 2.0", "MPL2_REF"),
                      ("gnu general public license (version 3|v3|v3.0)", "GPL3_REF"),
                      ("gnu general public license (version 2|v2|v2.0)", "GPL2_REF"),
                      ("gnu affero general public license (version 3|v3|v3.0)", "AGPL3_REF")):
    for _start in ("", "* (is|are) "):
        for _tail in ("", " see *"):
            TEMPLATES[f"{_start}(licensed|released|distributed|available) under the {_name}{_tail}"] = _ident
# Rules in order of precedence: identifiers in sequence, licence, class.
RULES = (
    (("MIT_GRANT_SHORT", "MIT_NOTICE", "AS_IS"), "MIT", "permissive"),
    (("APACHE2_REF", "APACHE_COMPLY", "APACHE_COPY"), "Apache-2.0", "permissive"),
    (("BSD_GRANT", "BSD_ENDORSE"), "BSD-3-Clause", "permissive"),
    (("GPL_GRANT",), "GPL", "copyleft"),
    (("GPL3_REF",), "GPL-3.0", "copyleft"),
    (("GPL2_REF",), "GPL-2.0", "copyleft"),
    (("AGPL3_REF",), "AGPL-3.0", "copyleft"),
    (("LGPL3_REF",), "LGPL-3.0", "copyleft"),
    (("LGPL21_REF",), "LGPL-2.1", "copyleft"),
    (("MPL2_REF",), "MPL-2.0", "copyleft"),
    (("CCBYNCND_REF",), "CC-BY-NC-ND-4.0", "noncommercial"),
    (("CCBYNC_REF",), "CC-BY-NC-4.0", "noncommercial"),
    (("CCBYSA_REF",), "CC-BY-SA-4.0", "copyleft"),
    (("CCBY_REF",), "CC-BY-4.0", "permissive"),
    (("CC0_REF",), "CC0-1.0", "permissive"),
    (("APACHE2_REF",), "Apache-2.0", "permissive"),
    (("MIT_REF",), "MIT", "permissive"),
    (("MIT_GRANT_SHORT",), "MIT", "permissive"),
    (("BSD3_REF",), "BSD-3-Clause", "permissive"),
    (("BSD2_REF",), "BSD-2-Clause", "permissive"),
    (("ISC_REF",), "ISC", "permissive"),
    (("BSD_GRANT",), "BSD-2-Clause", "permissive"),
    (("ISC_GRANT",), "ISC", "permissive"),
    (("ARR",), "all-rights-reserved", "closed"),
)


def cue(sentences) -> str:
    """A pattern that each of the (normalised) sentences or templates meets: a
    few of their words, the most common ones first. A word stands in a
    lower-cased text as it does in its normal form."""
    words = [{w for w in re.sub(r"\([^)]*\)", " ", s).split() if w != "*"} for s in sentences]
    words = [{w for w in own if len(w) >= 6} or own for own in words]     # short ones are in many texts
    out = []
    while words:
        found = Counter(w for own in words for w in own)
        out.append(max(found, key=lambda w: (found[w], len(w), w)))
        words = [own for own in words if out[-1] not in own]
    return "|".join(w.replace(".", "\\.") for w in out) or r"\z\A."


CUE = cue([*SENTENCES, *TEMPLATES])
SENTENCE_END = r"(?<=[.!?])[\x20\x09-\x0D]+"
PART_END = r"(?<=;)[\x20\x09\x0B-\x0D]+"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(text: Column) -> Column:
    """Normalised parts, one a line; a blank line where a sentence can't go on."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(text), SENTENCE_END, "\n\n"), PART_END, "\n")
    plain = F.regexp_replace(cut, r"[^a-z0-9.\n]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, r"\.+(?=[ \n]|\z)", ""), " *\n *", "\n"))


def _regex(sentence: str, gap: str = " ", wide: str = " ") -> str:
    """Pattern of a sentence or template; ``gap`` between its words, ``wide``
    between those of a slot that words precede."""
    out = ""
    for k, word in enumerate(re.sub(r"\([^)]*\)", lambda m: m[0].replace(" ", "_"), sentence).split()):
        if k:
            out += wide if word == "*" or out.endswith("?)") else gap
        if word == "*":
            out += f"(?:[a-z0-9.]+(?:{wide if k else ' '}[a-z0-9.]+){{0,11}}?)"
            out = out if k else out + "(?:)"
        else:
            out += word.replace(".", "\\.").replace("(", "(?:").replace("_", gap)
    return out


def _identifiers(text: Column, sentences: dict[str, str], templates: dict[str, str]) -> Column:
    longest = sorted({**templates, **sentences}, key=lambda s: (-len(s), s))
    if not longest:
        return F.array().cast("array<string>")
    any_of = "|".join(_regex(s, "[ \n]", "(?: |\n\n?)") for s in longest)
    found = F.regexp_extract_all(_parts(text), F.lit(rf"(?<![^\n])(?:{any_of})(?![^\n])"), F.lit(0))
    known = F.create_map(F.lit(""), F.lit(""), *[F.lit(x) for kv in sentences.items() for x in kv])

    def ident(part: Column) -> Column:
        flat = F.regexp_replace(part, "\n+", " ")
        out = F.when(F.map_contains_key(known, flat), F.element_at(known, flat))
        for s in (s for s in longest if s in templates):
            out = out.when(flat.rlike(f"^{_regex(s)}$"), F.lit(templates[s]))
        return out

    return F.transform(found, ident)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         sentences: dict[str, str] | None = None, rules=RULES, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_known (known sentences), sequence (their identifiers, comma
    joined), license (null without a known sentence), license_class, licenses
    (all matching rules' licences in rule order, comma joined, each once).
    With own ``sentences`` there are no templates but own ones."""
    templates = templates if templates is not None else TEMPLATES if sentences is None else {}
    sentences = SENTENCES if sentences is None else sentences
    slim = docs.select(docs[id_col].alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    ids = F.when(F.lower("_text").rlike(cue([*sentences, *templates])),
                 _identifiers(F.col("_text"), sentences, templates)) \
        .otherwise(F.array().cast("array<string>"))
    found = pin(slim, _ids=ids).drop("_text")
    seq = F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(","))
    hits = [F.contains(seq, F.lit("," + ",".join(need) + ",")) for need, _, _ in rules]

    def first(k: int) -> Column:
        out = F.when(hits[0], rules[0][k])
        for hit, rule in zip(hits[1:], rules[1:], strict=True):
            out = out.when(hit, rule[k])
        return F.when(F.size("_ids") > 0, F.coalesce(out, F.lit("unclear")))

    every = F.array_distinct(F.array_compact(F.array(
        *[F.when(hit, rule[1]) for hit, rule in zip(hits, rules, strict=True)])))
    return found.select("doc_id", F.size("_ids").cast("long").alias("n_known"),
                        F.array_join("_ids", ",").alias("sequence"), first(1).alias("license"),
                        first(2).alias("license_class"), F.array_join(every, ",").alias("licenses"))


def oracle(sentences: dict[str, str] | None = None, rules=RULES, templates: dict[str, str] | None = None) -> str:
    """The registered scan of ``documents`` for DuckDB."""
    templates = templates if templates is not None else TEMPLATES if sentences is None else {}
    sentences = SENTENCES if sentences is None else sentences
    q = lambda s: "'" + s.replace("'", "''") + "'"
    open_ones = " ".join(f"WHEN regexp_full_match(sentence, {q(_regex(s))}) THEN {q(templates[s])}"
                         for s in sorted(templates, key=lambda s: (-len(s), s)))
    open_ones = f"CASE {open_ones} END" if open_ones else "NULL"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in sentences.items())
    ruled = ", ".join(f"({k}, {q(',' + ','.join(need) + ',')}, {q(lic)}, {q(cls)})"
                      for k, (need, lic, cls) in enumerate(rules))
    return f"""
WITH known(sentence, ident) AS (VALUES {known}),
rules(rank, need, license, license_class) AS (VALUES {ruled}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
cut AS (SELECT rid, line_no,
               string_split(regexp_replace(line, '([.;!?])[ \\t\\v\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS p
        FROM lines),
parts AS (SELECT rid, line_no, unnest(p) AS s, generate_subscripts(p, 1) AS part_no FROM cut),
normal AS (SELECT rid, line_no, part_no,
                  trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'),
                                      '[.]+( |$)', '\\1', 'g')) AS sentence
           FROM parts),
told AS (SELECT sentence, coalesce(ident, {open_ones}) AS ident
         FROM (SELECT DISTINCT sentence FROM normal) LEFT JOIN known USING (sentence)),
seqs AS (SELECT rid, count(*) AS n_known,
                string_agg(ident, ',' ORDER BY line_no, part_no) AS sequence
         FROM normal JOIN told USING (sentence) WHERE ident IS NOT NULL GROUP BY rid),
hits AS (SELECT rid, arg_min(license, rank) AS license, arg_min(license_class, rank) AS license_class
         FROM seqs JOIN rules ON contains(',' || sequence || ',', need) GROUP BY rid),
firsts AS (SELECT rid, license, min(rank) AS rank
           FROM seqs JOIN rules ON contains(',' || sequence || ',', need) GROUP BY rid, license),
alls AS (SELECT rid, string_agg(license, ',' ORDER BY rank) AS licenses FROM firsts GROUP BY rid)
SELECT doc_id, coalesce(n_known, 0) AS n_known, coalesce(sequence, '') AS sequence,
       CASE WHEN n_known > 0 THEN coalesce(license, 'unclear') END AS license,
       CASE WHEN n_known > 0 THEN coalesce(license_class, 'unclear') END AS license_class,
       coalesce(licenses, '') AS licenses
FROM d LEFT JOIN seqs USING (rid) LEFT JOIN hits USING (rid) LEFT JOIN alls USING (rid)"""
