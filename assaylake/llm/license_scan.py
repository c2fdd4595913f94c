"""Licence scans by sentence rules, in DataFrame expressions alone.

A text is cut into sentences of lower-case words at [.!?:] and blank lines; known sentences map to
identifiers, and the sequence of a document's identifiers is matched against ordered licence rules
(a rule is a sequence of identifiers with at most GAP others between two of them). A sentence may end
at a line's end or a semicolon, but a known one goes on over them, so that wrapped texts and commented
headers are found as well as notices on one line. References (licensed under the ..., SPDX tags) are
known sentences with slots: any words may stand before and after them in their sentence. A rule that
lies inside a longer one that matched gives no match of its own. One pass over the rows, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"spdx-license-identifier[ \t]*:[ \t]*"
TAGGED = "spdxlicenseidentifier"  # stands for the tag: one word, so that its colon ends no sentence
ENDS = r"[.!?:]+[;.!?:]*[ \t\r\n]+|\n(?:[^\p{L}\p{N}\n]*\n)+"
LINES = r";+[ \t\r\n]+|\n"  # a sentence may end here or go on
NOT_WORD = r"[^\p{L}\p{N}\x01\x02]+"
GAP = 2

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache2.terms": ["you may not use this file except in compliance with the license"],
    "apache2.copy": ["you may obtain a copy of the license at"],
    "apache2.asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit.grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit.notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit.liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "gpl.grant": ["this program is free software", "this library is free software"],
    "gpl3.later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2.later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl3.later": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl21.later": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "agpl3.later": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl.asis": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd.grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd.asis": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd.liability": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "isc.grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc.asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "mpl2.subject": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl2.copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "unlicense.text": ["this is free and unencumbered software released into the public domain"],
    "bsl1.grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "reserved": ["all rights reserved"],
}
# Names of licences in references and tags, by identifier.
NAMES = {
    "apache2.ref": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "mit.ref": ["mit license", "mit"],
    "gpl3.later.ref": ["gpl 3 0 or later"],
    "gpl3.ref": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gpl 3 0 only", "gpl 3 0", "gplv3"],
    "gpl2.later.ref": ["gpl 2 0 or later"],
    "gpl2.ref": ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gpl 2 0 only", "gpl 2 0", "gplv2"],
    "lgpl3.ref": ["gnu lesser general public license version 3", "lgpl 3 0 or later", "lgpl 3 0 only", "lgpl 3 0"],
    "lgpl21.ref": ["gnu lesser general public license version 2 1", "lgpl 2 1 or later", "lgpl 2 1 only", "lgpl 2 1"],
    "agpl3.ref": ["gnu affero general public license version 3", "agpl 3 0 or later", "agpl 3 0 only", "agpl 3 0"],
    "bsd3.ref": ["bsd 3 clause license", "3 clause bsd license", "bsd 3 clause"],
    "bsd2.ref": ["bsd 2 clause license", "2 clause bsd license", "bsd 2 clause"],
    "isc.ref": ["isc license", "isc"],
    "mpl2.ref": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "epl2.ref": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "epl 2 0"],
    "unlicense.ref": ["unlicense"],
    "cc0.ref": ["creative commons cc0 1 0 universal", "cc0 1 0 universal", "cc0 1 0"],
    "bsl1.ref": ["boost software license version 1 0", "bsl 1 0"],
    "busl11.ref": ["business source license 1 1", "busl 1 1"],
    "ccbync4.ref": ["cc by nc 4 0"],
    "ccbysa4.ref": ["cc by sa 4 0"],
    "ccby4.ref": ["cc by 4 0"],
}
REFERENCE = r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?"
# Ordered rules: licence, class, sequence of identifiers. Earlier rules win over the ones inside them.
RULES = [
    ("Apache-2.0-notice", "permissive", ["apache2.ref", "apache2.terms", "apache2.copy", "apache2.asis"]),
    ("MIT-text", "permissive", ["mit.grant", "mit.notice", "mit.asis"]),
    ("BSD-3-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.names"]),
    ("BSD-2-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl.grant", "gpl3.later", "gpl.asis"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl.grant", "gpl2.later", "gpl.asis"]),
    ("LGPL-3.0-or-later", "copyleft", ["gpl.grant", "lgpl3.later", "gpl.asis"]),
    ("LGPL-2.1-or-later", "copyleft", ["gpl.grant", "lgpl21.later", "gpl.asis"]),
    ("AGPL-3.0-or-later", "copyleft", ["gpl.grant", "agpl3.later", "gpl.asis"]),
    ("ISC-text", "permissive", ["isc.grant", "isc.asis"]),
    ("MPL-2.0-notice", "copyleft", ["mpl2.subject", "mpl2.copy"]),
    ("Unlicense-text", "permissive", ["unlicense.text"]),
    ("BSL-1.0-text", "permissive", ["bsl1.grant"]),
    ("Apache-2.0", "permissive", ["apache2.ref"]),
    ("MIT", "permissive", ["mit.ref"]),
    ("GPL-3.0-or-later-ref", "copyleft", ["gpl3.later.ref"]),
    ("GPL-3.0", "copyleft", ["gpl3.ref"]),
    ("GPL-2.0-or-later-ref", "copyleft", ["gpl2.later.ref"]),
    ("GPL-2.0", "copyleft", ["gpl2.ref"]),
    ("LGPL-3.0", "copyleft", ["lgpl3.ref"]),
    ("LGPL-2.1", "copyleft", ["lgpl21.ref"]),
    ("AGPL-3.0", "copyleft", ["agpl3.ref"]),
    ("BSD-3-Clause-ref", "permissive", ["bsd3.ref"]),
    ("BSD-2-Clause-ref", "permissive", ["bsd2.ref"]),
    ("ISC", "permissive", ["isc.ref"]),
    ("MPL-2.0", "copyleft", ["mpl2.ref"]),
    ("EPL-2.0", "copyleft", ["epl2.ref"]),
    ("Unlicense", "permissive", ["unlicense.ref"]),
    ("CC0-1.0", "permissive", ["cc0.ref"]),
    ("BSL-1.0", "permissive", ["bsl1.ref"]),
    ("BUSL-1.1", "restricted", ["busl11.ref"]),
    ("CC-BY-NC-4.0", "restricted", ["ccbync4.ref"]),
    ("CC-BY-4.0", "permissive", ["ccby4.ref"]),
    ("CC-BY-SA-4.0", "copyleft", ["ccbysa4.ref"]),
    ("All-rights-reserved", "restricted", ["reserved"]),
]
KNOWN = {sentence: name for name, forms in SENTENCES.items() for sentence in forms} | {f"ref {form}": name for name, forms in NAMES.items() for form in forms}
CLASSES = ("restricted", "copyleft", "permissive")


def pattern(identifiers: list[str]) -> str:
    """A sequence of identifiers as a pattern over a document's runs: each between two ">", at most GAP others in a row between them."""
    return rf"(?:>[^>]+>){{0,{GAP}}}".join(">" + i.replace(".", "[.]") + ">" for i in identifiers)


def shadowed_by(rule: int) -> list[int]:
    """Earlier rules whose sequences hold the rule's own in order."""

    def inside(short: list[str], long: list[str]) -> bool:
        rest = iter(long)
        return all(i in rest for i in short)

    return [k for k in range(rule) if inside(RULES[rule][2], RULES[k][2])]


def longest_first(forms) -> str:
    return "|".join(s.replace(" ", r"[ \x02]+") for s in sorted(forms, key=lambda s: (-len(s), s)))


# Any known sentence between two ends, or a reference with its words around it.
WHOLE = longest_first(s for forms in SENTENCES.values() for s in forms)
SLOTTED = f"(?:{TAGGED} |{REFERENCE})".replace(" ", r"[ \x02]+") + f"(?:{longest_first(s for forms in NAMES.values() for s in forms)})"


def known_sentences(text: Column) -> Column:
    """Array of the known sentences in a text, normalised, in order; references as "ref" and the licence's name."""
    tagged = F.regexp_replace(F.translate(text, UPPER, LOWER), TAG, f"\n{TAGGED} ")
    marked = F.regexp_replace(F.regexp_replace(tagged, ENDS, "\x01"), LINES, "\x02")
    words = F.concat(F.lit("\x01"), F.regexp_replace(marked, NOT_WORD, " "), F.lit("\x01"))
    found = F.regexp_extract_all(words, F.lit(rf"(?<=[\x01\x02] ?)(?:{WHOLE})(?= ?[\x01\x02])|(?<=[ \x01\x02])(?:{SLOTTED})(?=[ \x01\x02])"), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(F.regexp_replace(s, r"[ \x02]+", " "), f"^(?:{TAGGED} |{REFERENCE})", "ref "))


def identifiers(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order."""
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.transform(known_sentences(text), lambda s: F.element_at(names, s))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs but the text, with n_known, sequence, licenses and license_class.

    sequence joins the identifiers by ">"; licenses joins the matched rules by "," in rule order;
    license_class is the strictest class among them, "none" without a match. A null or empty text has
    no identifiers. Repeated rows each get their own result, texts are read whole, and columns that
    clash with the new names are replaced.
    """
    made = ("n_known", "sequence", "licenses", "license_class")
    kept = [c for c in docs.columns if c != text_col and c not in made]
    row = [F.struct(*kept).alias("_row")] if kept else []
    found = docs.select(*row, F.coalesce(identifiers(F.col(text_col)), F.array().cast("array<string>")).alias("_ids"))
    runs = F.concat(F.lit(">"), F.array_join("_ids", ">>"), F.lit(">"))
    found = found.withColumn("_runs", runs)
    hits = [F.rlike("_runs", F.lit(pattern(ids))) if len(ids) > 1 else F.contains("_runs", F.lit(f">{ids[0]}>")) for _, _, ids in RULES]
    own = [h & ~_any([hits[k] for k in shadowed_by(i)]) if shadowed_by(i) else h for i, h in enumerate(hits)]
    licenses = F.array_join(F.array_compact(F.array(*[F.when(o, F.lit(name)) for o, (name, _, _) in zip(own, RULES, strict=True)])), ",")
    strictest = F.coalesce(*[F.when(_any([o for o, (_, k, _) in zip(own, RULES, strict=True) if k == c]), F.lit(c)) for c in CLASSES], F.lit("none"))
    return found.select(*["_row.*"] * len(row), F.size("_ids").cast("long").alias("n_known"), F.array_join("_ids", ">").alias("sequence"), licenses.alias("licenses"), strictest.alias("license_class"))


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def duckdb_sql() -> str:
    """The same scan of documents in DuckDB's SQL.

    Its patterns can't look around, so ends are doubled: a match may take one on either side.
    """
    names = ", ".join(f"'{s}': '{i}'" for s, i in KNOWN.items())
    hit = [f"regexp_matches(runs, '{pattern(ids)}')" for _, _, ids in RULES]
    own = [" AND ".join([h, *(f"NOT {hit[k]}" for k in shadowed_by(i))]) for i, h in enumerate(hit)]
    licenses = ", ".join(f"CASE WHEN {o} THEN '{name}' END" for o, (name, _, _) in zip(own, RULES, strict=True))
    strictest = " ".join(f"WHEN {' OR '.join(f'({o})' for o, (_, k, _) in zip(own, RULES, strict=True) if k == c)} THEN '{c}'" for c in CLASSES)
    text = f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TAG}', chr(10) || '{TAGGED} ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '{ENDS}', chr(1), 'g'), '{LINES}', chr(2), 'g')"
    text = rf"chr(1) || regexp_replace(regexp_replace({text}, '{NOT_WORD}', ' ', 'g'), '([\x01\x02])', '\1\1', 'g') || chr(1)"
    found = rf"regexp_extract_all({text}, '[\x01\x02] ?(?:{WHOLE}) ?[\x01\x02]|[ \x01\x02](?:{SLOTTED})[ \x01\x02]')"
    plain = r"trim(regexp_replace(s, '[ \x01\x02]+', ' ', 'g'))"
    return f"""
WITH split AS (SELECT doc_id, list_transform({found}, lambda s: regexp_replace({plain}, '^(?:{TAGGED} |{REFERENCE})', 'ref ')) AS parts FROM documents),
known AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: MAP {{{names}}}[s]), lambda i: i IS NOT NULL) AS ids FROM split),
seq AS (SELECT doc_id, len(ids) AS n_known, coalesce(array_to_string(ids, '>'), '') AS sequence, '>' || coalesce(array_to_string(ids, '>>'), '') || '>' AS runs FROM known)
SELECT doc_id, CAST(n_known AS BIGINT) AS n_known, sequence,
       coalesce(array_to_string(list_filter([{licenses}], lambda x: x IS NOT NULL), ','), '') AS licenses,
       CASE {strictest} ELSE 'none' END AS license_class
FROM seq"""
