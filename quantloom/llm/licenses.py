"""Licence scans by sentence rules: known licence sentences become identifiers, ordered rules match identifier sequences.

1. A text with a licence keyword is normalised: lower case, everything but letters a-z and digits is a space, sentence
   ends (``.!?;:`` after a word and before white space) and line breaks become boundary marks. Comment marks are not
   letters, so they vanish.
2. A known sentence starts and ends at a boundary of either kind and may run over line breaks; the longest known
   sentence wins. Every sentence found becomes its identifier, in text order.
3. Rules are tried in order. A rule is a sequence of neighbouring identifiers; every place where it matches, from the left,
   names its licence and uses up its identifiers, so a general rule never fires on sentences of a more special one, and
   what stood around them doesn't become neighbours. Identifiers that no rule uses stay open: a licence whose text is
   incomplete or unknown.

Everything is column expressions of one row, so there is no shuffle and nothing is gathered.

Besides the sentences of the table, a sentence may say in the usual words that something is under a licence ("The project is
licensed under the terms of the GPL version 3."), be the full name of a licence alone, or an SPDX expression, of which every
part joined by OR or AND becomes the identifier of its licence.

The table holds the notices and lines of the common licences and the titles of their full bodies, not every sentence of
the bodies; a sentence that names a person or firm in its midst can't be in it.

Defined results: null and empty texts have no sentences; repeated rows each get their row; texts are scanned whole,
whatever their length, with a few copies of one text in memory at a time; licences are distinct and in rule order; an empty table gives no rows; other columns stay away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every known sentence holds one of these within a word, where no line break or comment mark can split it.
WORD = r"licen[sc]|copyright|copying|permission|redistribut|warrant|domain|reserved|liab|notice|sublicens|gnu|mozilla|cc0|reproduction|gpl|mpl|epl|apache|expat|creative"
#: Known licence sentences, normalised; "|" stands for a sentence end inside.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit_title": ("mit license", "the mit license", "the mit license mit"),
    "mit_line": ("released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "distributed under the mit license", "spdx license identifier | mit"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit_as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit_liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "isc_as_is": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "isc_liability": ("in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",),
    "0bsd_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc_line": ("licensed under the isc license", "released under the isc license", "spdx license identifier | isc"),
    "bsd_conditions": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission", "3 | the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission", "3 | neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd_as_is": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "bsd_liability": ("in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services | loss of use data or profits | or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",),
    "bsd2_line": ("released under the bsd 2 clause license", "licensed under the bsd 2 clause license", "spdx license identifier | bsd 2 clause"),
    "bsd3_line": ("released under the bsd 3 clause license", "licensed under the bsd 3 clause license", "spdx license identifier | bsd 3 clause"),
    "apache_title": ("apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"),
    "apache_terms": ("terms and conditions for use reproduction and distribution",),
    "apache_under": ("licensed under the apache license version 2 0 the license",),
    "apache_comply": ("you may not use this file except in compliance with the license",),
    "apache_obtain": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache_unless": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache_see": ("see the license for the specific language governing permissions and limitations under the license",),
    "apache_line": ("licensed under the apache license version 2 0", "released under the apache license version 2 0", "this work is licensed under the apache license version 2 0", "spdx license identifier | apache 2 0"),
    "gpl2_title": ("gnu general public license version 2 june 1991",),
    "gpl3_title": ("gnu general public license version 3 29 june 2007",),
    "lgpl21_title": ("gnu lesser general public license version 2 1 february 1999",),
    "lgpl3_title": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl3_title": ("gnu affero general public license version 3 19 november 2007",),
    "gnu_verbatim": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",),
    "gpl2_only": ("this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",),
    "lgpl3_plus": ("this library is free software | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation | either version 3 of the license or at your option any later version",),
    "gpl2_plus": ("this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation | either version 2 of the license or at your option any later version",),
    "gpl3_plus": ("this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation | either version 3 of the license or at your option any later version"),
    "lgpl21_plus": ("this library is free software | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation | either version 2 1 of the license or at your option any later version",),
    "agpl3_plus": ("this program is free software | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gnu_warranty": ("this program is distributed in the hope that it will be useful but without any warranty | without even the implied warranty of merchantability or fitness for a particular purpose", "this library is distributed in the hope that it will be useful but without any warranty | without even the implied warranty of merchantability or fitness for a particular purpose"),
    "gnu_see": ("see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"),
    "gpl2_line": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "spdx license identifier | gpl 2 0 only"),
    "gpl3_line": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "spdx license identifier | gpl 3 0 only"),
    "mpl2_subject": ("this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v | 2 0"),
    "mpl2_obtain": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "mpl2_line": ("licensed under the mozilla public license version 2 0", "spdx license identifier | mpl 2 0"),
    "mpl2_title": ("mozilla public license version 2 0",),
    "epl2_terms": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at http www eclipse org legal epl 2 0"),
    "epl2_title": ("eclipse public license v 2 0",),
    "zlib_as_is": ("this software is provided as is without any express or implied warranty",),
    "zlib_liability": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "bsl_grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "bsl_line": ("distributed under the boost software license version 1 0", "spdx license identifier | bsl 1 0"),
    "cc_by_line": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier | cc by 4 0"),
    "cc_by_sa_line": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "spdx license identifier | cc by sa 4 0"),
    "cc_by_nc_line": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "spdx license identifier | cc by nc 4 0"),
    "cc_by_nd_line": ("licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc0_line": ("licensed under cc0 1 0", "released under cc0 1 0", "spdx license identifier | cc0 1 0"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "public_domain": ("this work is in the public domain", "this file is in the public domain"),
    "reserved": ("all rights reserved",),
}

#: What may stand before "licensed under", and words for it.
LEAD = (
    "(?:(?:the|this|our|all) (?:project|software|library|program|package|code|source code|source|file|files|module|repository|tool|document|documentation|work|data|dataset|content|material|plugin|app|application)"
    " (?:is|are) |it is |it s )?(?:also |now |hereby |dual )?"
)
VERB = "(?:licensed|released|distributed|available|made available|published|provided|offered|covered|shared) (?:under|by|with) (?:the )?(?:terms of )?(?:the )?"
#: Names of licences, the families of GNU's with their versions.
PLAIN_NAMES = {
    "mit_line": ("mit license", "mit", "mit x11 license", "expat license"),
    "apache_line": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license v2", "apache 2 0 license", "apache 2 0", "apache software license version 2 0", "apache license 2"),
    "bsd2_line": ("bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license", "bsd 2 clause simplified license"),
    "bsd3_line": ("bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause new or revised license"),
    "isc_line": ("isc license", "isc"),
    "mpl2_line": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl v2 0", "mpl version 2 0"),
    "bsl_line": ("boost software license version 1 0", "boost software license 1 0", "boost license"),
    "zlib_line": ("zlib license",),
    "unlicense_line": ("unlicense",),
    "epl2_line": ("eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v2 0", "epl 2 0"),
    "cc0_line": ("cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero v1 0 universal"),
    "cc_by_line": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    "cc_by_sa_line": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "cc_by_nc_line": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "cc_by_nd_line": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
}
GNU_FAMILIES = {
    "gpl2": (("gnu general public license", "general public license", "gnu gpl", "gpl"), "2"), "gpl3": (("gnu general public license", "general public license", "gnu gpl", "gpl"), "3"),
    "lgpl21": (("gnu lesser general public license", "gnu lgpl", "lgpl"), "2 1"), "lgpl3": (("gnu lesser general public license", "gnu lgpl", "lgpl"), "3"),
    "agpl3": (("gnu affero general public license", "gnu agpl", "agpl"), "3"),
}
LATER = ("or later", "or any later version", "or at your option any later version", "or newer")
#: SPDX identifiers, normalised, "plus" for "or later".
SPDX = {
    "mit": "mit_line", "apache 2 0": "apache_line", "bsd 2 clause": "bsd2_line", "bsd 3 clause": "bsd3_line", "isc": "isc_line", "mpl 2 0": "mpl2_line", "bsl 1 0": "bsl_line", "zlib": "zlib_line", "unlicense": "unlicense_line",
    "epl 2 0": "epl2_line", "cc0 1 0": "cc0_line", "cc by 4 0": "cc_by_line", "cc by sa 4 0": "cc_by_sa_line", "cc by nc 4 0": "cc_by_nc_line", "cc by nd 4 0": "cc_by_nd_line", "0bsd": "0bsd_line",
    "gpl 2 0": "gpl2_line", "gpl 2 0 only": "gpl2_line", "gpl 2 0 plus": "gpl2_later_line", "gpl 3 0": "gpl3_line", "gpl 3 0 only": "gpl3_line", "gpl 3 0 plus": "gpl3_later_line",
    "lgpl 2 1": "lgpl21_line", "lgpl 2 1 only": "lgpl21_line", "lgpl 2 1 plus": "lgpl21_later_line", "lgpl 3 0": "lgpl3_line", "lgpl 3 0 only": "lgpl3_line", "lgpl 3 0 plus": "lgpl3_later_line",
    "agpl 3 0": "agpl3_line", "agpl 3 0 only": "agpl3_line", "agpl 3 0 plus": "agpl3_later_line",
}


def licence_names() -> dict[str, str]:
    """{name: identifier}; GNU's names are made of family, spelling of the version and what is said of later ones."""
    names = {n: x for x, many in PLAIN_NAMES.items() for n in many}
    for short, (families, version) in GNU_FAMILIES.items():
        full = version if " " in version else f"{version} 0"
        for family in families:
            spelled = [f"{family} {v}" for v in (f"version {version}", f"v{version}", version, f"version {full}", f"v{full}", full)]
            spelled += [f"{family}v{version}", f"{family}{version}"] if " " not in family else []
            for name in dict.fromkeys(spelled):
                names[name] = f"{short}_line"
                names |= {f"{name} {later}": f"{short}_later_line" for later in LATER}
    return names


NAMES = licence_names()
#: Names that are a sentence by themselves.
TITLES = tuple(n for n in NAMES if "license" in n and len(n.split()) >= 4)

#: Licences and the identifier sequences that show them; the first that fits comes first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("ISC", ("isc_grant", "isc_as_is", "isc_liability")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("0BSD", ("0bsd_grant", "isc_as_is", "isc_liability")),
    ("0BSD", ("0bsd_grant", "isc_as_is")),
    ("BSL-1.0", ("bsl_grant",)),
    ("Zlib", ("zlib_as_is", "zlib_liability", "zlib_grant")),
    ("BSD-3-Clause", ("bsd_conditions", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "bsd_liability")),
    ("BSD-2-Clause", ("bsd_conditions", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_liability")),
    ("BSD-3-Clause", ("bsd_conditions", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_conditions", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("Apache-2.0", ("apache_title", "apache_terms")),
    ("Apache-2.0", ("apache_under", "apache_comply", "apache_obtain", "apache_unless", "apache_see")),
    ("Apache-2.0", ("apache_under", "apache_comply", "apache_obtain")),
    ("Apache-2.0", ("apache_under", "apache_comply")),
    ("GPL-2.0-only", ("gpl2_title", "gnu_verbatim")),
    ("GPL-3.0-only", ("gpl3_title", "gnu_verbatim")),
    ("LGPL-2.1-only", ("lgpl21_title", "gnu_verbatim")),
    ("LGPL-3.0-only", ("lgpl3_title", "gnu_verbatim")),
    ("AGPL-3.0-only", ("agpl3_title", "gnu_verbatim")),
    ("GPL-2.0-only", ("gpl2_only", "gnu_warranty", "gnu_see")),
    ("GPL-2.0-only", ("gpl2_only",)),
    ("LGPL-3.0-or-later", ("lgpl3_plus", "gnu_warranty", "gnu_see")),
    ("LGPL-3.0-or-later", ("lgpl3_plus",)),
    ("GPL-2.0-or-later", ("gpl2_plus", "gnu_warranty", "gnu_see")),
    ("GPL-2.0-or-later", ("gpl2_plus",)),
    ("GPL-3.0-or-later", ("gpl3_plus", "gnu_warranty", "gnu_see")),
    ("GPL-3.0-or-later", ("gpl3_plus",)),
    ("LGPL-2.1-or-later", ("lgpl21_plus", "gnu_warranty", "gnu_see")),
    ("LGPL-2.1-or-later", ("lgpl21_plus",)),
    ("AGPL-3.0-or-later", ("agpl3_plus", "gnu_warranty", "gnu_see")),
    ("AGPL-3.0-or-later", ("agpl3_plus",)),
    ("MPL-2.0", ("mpl2_subject", "mpl2_obtain")),
    ("EPL-2.0", ("epl2_terms",)),
    ("MIT", ("mit_line",)),
    ("MIT", ("mit_title",)),
    ("Apache-2.0", ("apache_title",)),
    ("MPL-2.0", ("mpl2_title",)),
    ("EPL-2.0", ("epl2_title",)),
    ("BSL-1.0", ("bsl_line",)),
    ("ISC", ("isc_line",)),
    ("BSD-2-Clause", ("bsd2_line",)),
    ("BSD-3-Clause", ("bsd3_line",)),
    ("Apache-2.0", ("apache_line",)),
    ("GPL-2.0-only", ("gpl2_line",)),
    ("GPL-3.0-only", ("gpl3_line",)),
    ("MPL-2.0", ("mpl2_line",)),
    ("GPL-2.0-or-later", ("gpl2_later_line",)),
    ("GPL-3.0-or-later", ("gpl3_later_line",)),
    ("LGPL-2.1-only", ("lgpl21_line",)),
    ("LGPL-2.1-or-later", ("lgpl21_later_line",)),
    ("LGPL-3.0-only", ("lgpl3_line",)),
    ("LGPL-3.0-or-later", ("lgpl3_later_line",)),
    ("AGPL-3.0-only", ("agpl3_line",)),
    ("AGPL-3.0-or-later", ("agpl3_later_line",)),
    ("Zlib", ("zlib_line",)),
    ("EPL-2.0", ("epl2_line",)),
    ("0BSD", ("0bsd_line",)),
    ("CC-BY-4.0", ("cc_by_line",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_line",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_line",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_line",)),
    ("CC0-1.0", ("cc0_line",)),
    ("Unlicense", ("unlicense",)),
    ("Unlicense", ("unlicense_line",)),
    ("Public-Domain", ("public_domain",)),
    ("Proprietary", ("reserved",)),
)

#: Marks of a sentence end and of a line break in normalised text; each stands twice, so that neighbours can share it.
END, LINE = "| | ", "/ / "

#: Steps of normalisation, after lower case: (pattern, replacement), in the syntax that Java and RE2 share.
STEPS = (
    (r"([a-z0-9)\]}\"'>*%&$#~_-])[.!?;:][^a-z0-9\s]*\s", "\\1 \x01 "),
    (r"[^a-z0-9\x01]*\n[^a-z0-9\x01]*", " \x02 "),
    (r"[^a-z0-9\x01\x02]+", " "),
)


MARK = rf"(?:{LINE})?"
SPDX_BEGIN = "spdx license identifier | | "


def _words(sentence: str) -> str:
    return MARK.join(w + " " if w != "|" else r"\| \| " for w in sentence.split())


def _alternatives(sentences) -> str:
    return "|".join(_words(x) for x in sorted(sentences, key=lambda x: (-len(x), x)))


def _said(words: str) -> str:
    """A pattern of words with line breaks allowed after each."""
    return words.replace(" ", f" {MARK}")


def sentence_pattern() -> str:
    """Known sentences, the longest first, what is said to be under a licence, names of licences and SPDX expressions, between
    boundaries."""
    known = _alternatives({x for many in SENTENCES.values() for x in many})
    parts = _alternatives(x.replace(" plus", " or later") for x in SPDX)
    expression = _words("spdx license identifier |") + MARK + f"(?:{parts})(?:{MARK}(?:or|and) {MARK}(?:{parts}))*"
    return rf"[|/] ((?:{known}|{_said(LEAD)}{_said(VERB)}(?:{_alternatives(NAMES)})|{_alternatives(TITLES)}|{expression}))[|/]"


#: Steps from a sentence found to the names of its identifiers, after line breaks are gone: (pattern, replacement).
REST = ((rf"^{LEAD}{VERB}", ""), (r"^spdx license identifier \| \| (.* (?:or|and) )", "\\1"), (r" or later ", " plus "))


def identifiers() -> dict[str, str]:
    """{what is left of a sentence: identifier}; whole sentences of the table are looked up as they are."""
    table = {x.replace("|", "| |") + " ": name for name, many in SENTENCES.items() for x in many}
    spdx = {SPDX_BEGIN + k + " ": v for k, v in SPDX.items()} | {k + " ": v for k, v in SPDX.items()}
    return {n + " ": x for n, x in NAMES.items()} | spdx | {n.replace(" or later", " plus") + " ": x for n, x in NAMES.items()} | table


def normalised(text: Column) -> Column:
    """Words and boundary marks of a text, each followed by a space."""
    t = F.concat(F.lit("\n"), F.lower(text), F.lit(" \n"))
    for pattern, to in STEPS:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(to.replace("\\1", "$1")))
    t = F.regexp_replace(t, F.lit("\x02[\x02 ]*"), F.lit(LINE))
    return F.regexp_replace(t, F.lit(" *\x01 *"), F.lit(f" {END}"))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    found = F.regexp_extract_all(normalised(text), F.lit(sentence_pattern()), F.lit(1))
    pairs = [x for pair in identifiers().items() for x in pair]
    names = F.create_map(*(F.lit(x) for x in pairs))

    def of_sentence(sentence: Column) -> Column:
        plain = F.replace(sentence, F.lit(LINE), F.lit(""))
        rest = plain
        for pattern, to in REST:
            rest = F.regexp_replace(rest, F.lit(pattern), F.lit(to.replace("\\1", "$1")))
        parts = F.transform(F.split(F.rtrim(rest), " (?:or|and) "), lambda p: F.element_at(names, F.concat(p, F.lit(" "))))
        known = F.coalesce(F.element_at(names, plain), F.element_at(names, rest))
        return F.when(known.isNotNull(), F.array(known)).otherwise(parts)

    none = F.array().cast("array<string>")
    return F.when(F.lower(text).rlike(WORD), F.flatten(F.transform(found, of_sentence))).otherwise(none)


#: Stands where a rule used identifiers up, so that those around it are no neighbours.
GONE = "|"


def as_sequence(ids: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in ids)


def matched(ids: Column) -> Column:
    """Struct of (left: the identifiers that no rule used, as a sequence; found: licences in rule order)."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(as_sequence(s)).alias("sequence")) for name, s in RULES))
    start = F.struct(
        F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("left"),
        F.array().cast("array<string>").alias("found"),
    )

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["sequence"])
        left = F.when(hit, F.replace(state["left"], rule["sequence"], F.lit(GONE))).otherwise(state["left"])
        return F.struct(left.alias("left"), F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    return F.aggregate(rules, start, apply)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_sentences, n_open, sentence_ids, licenses): known sentences, those no rule used, identifiers and
    licences, both as comma-separated text."""
    ids = docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))
    return ids.select(F.col(id_col), "ids", matched(F.col("ids")).alias("m")).select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_sentences"),
        (F.length("m.left") - F.length(F.replace("m.left", F.lit("<"), F.lit("")))).cast("long").alias("n_open"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("m.found"), ",").alias("licenses"),
    )
