"""Licence scans by sentence rules.

A text is cut into sentences at sentence marks and ends of paragraphs, and those that are not known also at line ends; each is normalised (lower case, only letters and
digits, single spaces) and looked up among known licence sentences; the identifiers found, in order,
are matched against ordered rules over identifier sequences, most specific first; every rule whose
sequence occurs, and that is not part of one matched before it, names a licence.

Native: DataFrame functions only, one pass, no shuffle. The tables of sentences and rules are fixed and
bounded (a few hundred sentences of some thirty families; notices are made from names and templates). Sentences that name whoever holds
the rights have a slot there, and expressions such as those of SPDX tags give the identifiers of all licences that they name, if all are known. Sentences are only cut where the
text holds a word that every known sentence has one of.

Defined results: null or empty texts have no sentences and no licence; repeated sentences count each time in
`sentence_ids` and once in `licenses`; texts are read whole; columns sentence_ids and licenses are replaced, others stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import LOWER, UPPER, let, table

#: Normalised licence sentences (public licence texts and notices) and their identifiers.
TEXTS = {
    # MIT, X11, ISC, zlib, Boost
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "except as contained in this notice the name of the copyright holders shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization": "X11Name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroBsdGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscAsIs",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "IscLiability",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "distributed under the boost software license version 1 0": "BoostRef",
    # Apache 2.0: notice and text
    "licensed under the apache license version 2 0": "Apache2Ref",
    "licensed under the apache license version 2 0 the license": "Apache2Ref",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "Apache2Ref",
    "you may not use this file except in compliance with the license": "Apache2Comply",
    "you may obtain a copy of the license at": "Apache2Copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache2Copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "Apache2Copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2Warranty",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2Warranty",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2See",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "Apache2Defined",
    "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license": "Apache2Licensor",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "Apache2Grant",
    "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions": "Apache2Redistribution",
    "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file": "Apache2Trademarks",
    # BSD
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNoEndorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BsdAdvertising",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdAsIs",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdLiability",
    # GNU
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "Gpl3Only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2Only",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "if not see https www gnu org licenses": "GnuUrl",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "Gpl3Preamble",
    "the licenses for most software are designed to take away your freedom to share and change it": "Gpl2Preamble",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "GnuVerbatim",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21Later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LgplWarranty",
    "see the gnu lesser general public license for more details": "LgplSee",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "Lgpl3Text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Later",
    "see the gnu affero general public license for more details": "AgplSee",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "Agpl3Preamble",
    # Mozilla, Eclipse
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "Mpl2Copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "Mpl2Copy",
    "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0": "Mpl2Incompatible",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2Ref",
    # public domain
    "this is free and unencumbered software released into the public domain": "UnlicenseRef",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseGrant",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "Cc0Waiver",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "Cc0Deed",
    "do what the fuck you want to public license": "WtfplRef",
    "all rights reserved": "Reserved",
}
#: What licences are called in notices, normalised, and the identifier of such a notice.
NAMES = {
    "mit license": "MitRef", "isc license": "IscRef", "zlib license": "ZlibRef", "boost software license version 1 0": "BoostRef", "unlicense": "UnlicenseRef",
    "apache license version 2 0": "Apache2Ref", "apache license 2 0": "Apache2Ref", "apache 2 0 license": "Apache2Ref",
    "bsd 2 clause license": "Bsd2Ref", "bsd 3 clause license": "Bsd3Ref", "simplified bsd license": "Bsd2Ref", "new bsd license": "Bsd3Ref",
    "gnu general public license version 3": "Gpl3Ref", "gnu general public license v3 0": "Gpl3Ref", "gnu gpl v3": "Gpl3Ref",
    "gnu general public license version 2": "Gpl2Ref", "gnu general public license v2 0": "Gpl2Ref", "gnu gpl v2": "Gpl2Ref",
    "gnu lesser general public license version 3": "Lgpl3Ref", "gnu lesser general public license version 2 1": "Lgpl21Ref",
    "gnu affero general public license version 3": "Agpl3Ref", "mozilla public license version 2 0": "Mpl2Ref", "mozilla public license 2 0": "Mpl2Ref",
    "eclipse public license 2 0": "Epl2Ref", "eclipse public license version 2 0": "Epl2Ref",
}
NOTICES = ["licensed under the {}", "released under the {}", "distributed under the {}", "this project is licensed under the {}", "this work is licensed under the {}", "this software is licensed under the {}", "this code is released under the {}", "distributed under the terms of the {}", "available under the {}"]
#: The Creative Commons licences, by their short names and long ones.
COMMONS = {
    "by": ("CcBy", "attribution"), "by sa": ("CcBySa", "attribution sharealike"), "by nc": ("CcByNc", "attribution noncommercial"), "by nd": ("CcByNd", "attribution noderivatives"),
    "by nc sa": ("CcByNcSa", "attribution noncommercial sharealike"), "by nc nd": ("CcByNcNd", "attribution noncommercial noderivatives"),
}
VERSIONS = {"4 0": ("4", "international"), "3 0": ("3", "unported")}
#: Identifiers of SPDX that a tag may name.
SPDX = {
    "MIT": "MitRef", "ISC": "IscRef", "Zlib": "ZlibRef", "BSL-1.0": "BoostRef", "0BSD": "ZeroBsdRef", "Unlicense": "UnlicenseRef", "Apache-2.0": "Apache2Ref", "BSD-2-Clause": "Bsd2Ref",
    "BSD-3-Clause": "Bsd3Ref", "GPL-3.0-or-later": "Gpl3Later", "GPL-3.0-only": "Gpl3Ref", "GPL-2.0-or-later": "Gpl2Later", "GPL-2.0-only": "Gpl2Ref", "LGPL-3.0-or-later": "Lgpl3Later",
    "GPL-3.0": "Gpl3Ref", "GPL-2.0": "Gpl2Ref", "LGPL-3.0-only": "Lgpl3Ref", "LGPL-3.0": "Lgpl3Ref", "LGPL-2.1-only": "Lgpl21Ref", "LGPL-2.1": "Lgpl21Ref", "AGPL-3.0": "Agpl3Ref",
    "LGPL-2.1-or-later": "Lgpl21Later", "AGPL-3.0-or-later": "Agpl3Later", "AGPL-3.0-only": "Agpl3Ref", "MPL-2.0": "Mpl2Ref", "EPL-2.0": "Epl2Ref", "CC0-1.0": "Cc0Waiver", "WTFPL": "WtfplRef",
}


def _sentences() -> dict[str, str]:
    """All known sentences: the texts, notices by name, Creative Commons notices and SPDX tags."""
    out = dict(TEXTS)
    out |= {n.format(name): i for name, i in NAMES.items() for n in NOTICES}
    for short, (i, long) in COMMONS.items():
        for version, (v, scope) in VERSIONS.items():
            out |= {n.format(f"cc {short} {version}").replace("the cc", "cc"): f"{i}{v}Ref" for n in NOTICES}
            out |= {n.format(f"creative commons {long} {version} {scope} license").replace("the creative", "a creative"): f"{i}{v}Ref" for n in NOTICES}
    spdx = {name: re.sub("[^a-z0-9]+", " ", name.lower()) for name in SPDX}
    return out | {f"spdx license identifier {spdx[name]}": i for name, i in SPDX.items()}


SENTENCES = _sentences()
#: Sentences with a slot for whoever holds the rights, and the known sentence that each stands for; a holder such as `X, Inc.` ends a sentence of
#: its own, so the beginnings may be missing.
HOLDERS = [
    (r"^(?:neither the names? of .{1,150}? )?nor the names of (?:its|their|his|her|any|the)?(?: copyright)? ?contributors may be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (r"^the names? of .{1,150}? may not be used to endorse or promote products derived from this software without", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without"),
    (r"^(?:this software is provided by .{1,150}? )?as is and any express or implied warranties", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    (r"^(?:in no event shall .{1,150}? )?be liable for any direct indirect incidental", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental"),
    (r"^(?:in no event shall .{1,150}? )?be liable for any claim damages or other liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
]
#: What names one or more licences; the names are joined by or, and, with. `or later` belongs to a name.
TAG = "^(?:spdx license identifier|licen[sc]es?|(?:this (?:project|software|work|code|file) is )?(?:dual )?licen[sc]ed under(?: either of)?)(?: the)? "
JOINED = " (?:or|and|with) (?:the )?"


def _names() -> dict[str, str]:
    """Names of licences as they stand in expressions, normalised, with `or later` as one word."""
    spdx = {re.sub("[^a-z0-9]+", " ", name.lower()).replace(" or later", " orlater"): i for name, i in SPDX.items()}
    return NAMES | spdx | {f"{n} license": i for n, i in spdx.items()} | {"apache": "Apache2Ref", "apache license": "Apache2Ref", "bsd 3 clause": "Bsd3Ref", "bsd 2 clause": "Bsd2Ref"}


EXPRESSED = _names()
#: A licence, the sequence of identifiers that means it; longer sequences of a family first.
RULES = [
    ("Apache-2.0", ["Apache2Ref", "Apache2Comply", "Apache2Copy", "Apache2Warranty", "Apache2See"]),
    ("Apache-2.0", ["Apache2Ref", "Apache2Comply", "Apache2Warranty", "Apache2See"]),
    ("Apache-2.0", ["Apache2Ref", "Apache2Warranty", "Apache2See"]),
    ("Apache-2.0", ["Apache2Defined", "Apache2Licensor", "Apache2Grant", "Apache2Redistribution", "Apache2Trademarks"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAdvertising", "BsdNoEndorse"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse", "BsdAsIs", "BsdLiability"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("X11", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability", "X11Name"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("Unlicense", ["UnlicenseRef", "UnlicenseGrant", "MitAsIs", "MitLiability"]),
    ("Unlicense", ["UnlicenseRef", "UnlicenseGrant"]),
    ("ISC", ["IscGrant", "IscAsIs", "IscLiability"]),
    ("ISC", ["IscGrant"]),
    ("0BSD", ["ZeroBsdGrant", "IscAsIs", "IscLiability"]),
    ("0BSD", ["ZeroBsdGrant"]),
    ("Zlib", ["ZlibAsIs", "ZlibLiability", "ZlibGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("AGPL-3.0-or-later", ["Agpl3Later", "GplWarranty", "AgplSee"]),
    ("AGPL-3.0-only", ["GnuVerbatim", "Agpl3Preamble"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later", "LgplWarranty", "LgplSee"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later", "LgplWarranty", "LgplSee"]),
    ("LGPL-3.0-only", ["GnuVerbatim", "Lgpl3Text"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GplWarranty", "GplSee", "GplCopy"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GplWarranty"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GplWarranty", "GplSee", "GplCopy"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GplWarranty"]),
    ("GPL-3.0-only", ["Gpl3Only", "GplWarranty"]),
    ("GPL-2.0-only", ["Gpl2Only", "GplWarranty"]),
    ("GPL-3.0-only", ["GnuVerbatim", "Gpl3Preamble"]),
    ("GPL-2.0-only", ["GnuVerbatim", "Gpl2Preamble"]),
    ("MPL-2.0", ["Mpl2Ref", "Mpl2Copy"]),
    ("MPL-2.0-no-copyleft-exception", ["Mpl2Ref", "Mpl2Incompatible"]),
    ("AGPL-3.0-or-later", ["Agpl3Later"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("GPL-3.0-only", ["Gpl3Only"]),
    ("GPL-2.0-only", ["Gpl2Only"]),
    ("Apache-2.0", ["Apache2Ref"]),
    ("MIT", ["MitRef"]),
    ("ISC", ["IscRef"]),
    ("0BSD", ["ZeroBsdRef"]),
    ("Zlib", ["ZlibRef"]),
    ("BSL-1.0", ["BoostRef"]),
    ("BSD-2-Clause", ["Bsd2Ref"]),
    ("BSD-3-Clause", ["Bsd3Ref"]),
    ("Unlicense", ["UnlicenseRef"]),
    ("GPL-3.0-only", ["Gpl3Ref"]),
    ("GPL-2.0-only", ["Gpl2Ref"]),
    ("LGPL-3.0-only", ["Lgpl3Ref"]),
    ("LGPL-2.1-only", ["Lgpl21Ref"]),
    ("AGPL-3.0-only", ["Agpl3Ref"]),
    ("MPL-2.0", ["Mpl2Ref"]),
    ("EPL-2.0", ["Epl2Ref"]),
    ("CC0-1.0", ["Cc0Waiver"]),
    ("CC0-1.0", ["Cc0Deed"]),
    ("WTFPL", ["WtfplRef"]),
    *[(f"CC-{short.upper().replace(' ', '-')}-{version.replace(' ', '.')}", [f"{i}{v}Ref"]) for short, (i, _) in COMMONS.items() for version, (v, _) in VERSIONS.items()],
    ("All-rights-reserved", ["Reserved"]),
]
#: A word of each known sentence.
HINT = "(?i)licen[sc]e|permission|software|redistribut|warrant|rights[^a-z0-9]+reserved|the[^a-z0-9]+name[^a-z0-9]+of[^a-z0-9]+the[^a-z0-9]+copyright[^a-z0-9]+holder|the[^a-z0-9]+public[^a-z0-9]+domain|distributed[^a-z0-9]+with[^a-z0-9]+this[^a-z0-9]+file|neighboring[^a-z0-9]+rights|derivative[^a-z0-9]+works|under[^a-z0-9]+(?:cc[^a-z0-9]+by|the[^a-z0-9]+gnu|the[^a-z0-9]+terms)"
#: Where sentences end: line by line, and over the line ends within a paragraph.
LINES, PARAGRAPHS = r"[\r\n]+|[.?](?=\s)\s*", r"\r?\n\s*\n\s*|[.?](?=\s)\s*"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _ids(sentence: Column) -> Column:
    """Identifiers of one sentence: its own, or those of the licences that it names; null if it is not known."""

    def of(n: Column) -> Column:
        own = F.element_at(_table(SENTENCES), n)
        named = F.split(F.regexp_replace(F.regexp_replace(n, " or later", " orlater"), TAG, ""), JOINED)
        ids = F.transform(named, lambda x: F.element_at(_table(EXPRESSED), x))
        every = F.when(F.forall(ids, lambda x: x.isNotNull()), ids)
        before = F.when(n.rlike(" licensed$"), F.element_at(_table(EXPRESSED), F.regexp_replace(n, " licensed$", "")))  # MIT licensed
        return F.when(own.isNotNull(), F.array(own)).when(n.rlike(TAG), every).when(before.isNotNull(), F.array(before))

    normal = F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))
    for pattern, known in HOLDERS:
        normal = F.regexp_replace(normal, pattern, known)
    return let(normal, of)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order: of each sentence of a paragraph its own, or else those of its lines."""
    hinted = lambda s, cut: F.filter(F.split(s, cut), lambda x: x.rlike(HINT))

    def known(s: Column) -> Column:
        lines = F.flatten(F.filter(F.transform(hinted(s, LINES), _ids), lambda x: x.isNotNull()))
        return let(_ids(s), lambda own: F.coalesce(own, lines))

    return F.when(text.rlike(HINT), F.flatten(F.transform(hinted(text, PARAGRAPHS), known))).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with sentence_ids array<string> and licenses array<string> (in the order of RULES)."""
    out = df.withColumn("sentence_ids", F.coalesce(sentence_ids(F.col(text)), F.array().cast("array<string>")))
    state = F.struct(F.concat(F.lit(" "), F.concat_ws(" ", "sentence_ids"), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {' '.join(ids)} ").alias("ids")) for name, ids in RULES])

    def use(s: Column, r: Column) -> Column:
        hit = F.contains(s["rest"], r["ids"])
        return F.struct(
            F.when(hit, F.replace(F.replace(s["rest"], r["ids"], F.lit(" | ")), r["ids"], F.lit(" | "))).otherwise(s["rest"]).alias("rest"),
            F.when(hit, F.array_append(s["found"], r["name"])).otherwise(s["found"]).alias("found"),
        )

    spaced = F.aggregate(rules, state, use)["found"]
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, F.array_distinct(spaced)).otherwise(F.array().cast("array<string>")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"))


def _op1_sql() -> str:
    known = ", ".join(f"('{a}', '{b}')" for a, b in SENTENCES.items())
    expr, rest = [], "rest0"
    steps = [f"SELECT doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' AS rest0 FROM g"]
    for i, (name, ids) in enumerate(RULES):
        seq = f" {' '.join(ids)} "
        steps.append(f"SELECT *, CASE WHEN contains({rest}, '{seq}') THEN '{name}' END AS f{i}, replace(replace({rest}, '{seq}', ' | '), '{seq}', ' | ') AS rest{i + 1} FROM (%s)")
        rest = f"rest{i + 1}"
        expr.append(f"f{i}")
    query = steps[0]
    for step in steps[1:]:
        query = step % query
    first = ", ".join(f"CASE WHEN {' OR '.join([f'{expr[j]} IS NOT NULL' for j in range(i) if RULES[j][0] == RULES[i][0]]) or 'FALSE'} THEN NULL ELSE {x} END" for i, x in enumerate(expr))
    normal = f"trim(regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    slotted = normal.format("s")
    for pattern, canonical in HOLDERS:
        slotted = f"regexp_replace({slotted}, '{pattern}', '{canonical}')"
    expressed = ", ".join(f"('{a}', '{b}')" for a, b in EXPRESSED.items())

    def ids_of(rows: str) -> str:
        """CTEs that give (doc_id, i, j, q, id) of sentences rows(doc_id, i, j, s)."""
        return rf"""{rows}n AS (SELECT doc_id, i, j, {slotted} AS n FROM {rows}),
{rows}d AS (SELECT doc_id, i, j, 0 AS q, id FROM {rows}n JOIN k ON k.s = n),
{rows}e AS (SELECT doc_id, i, j, unnest(range(len(x))) AS q, unnest(x) AS s, len(x) AS c FROM (SELECT doc_id, i, j, CASE WHEN regexp_matches(n, '{TAG}') THEN string_split_regex(regexp_replace(replace(n, ' or later', ' orlater'), '{TAG}', ''), '{JOINED}')
 WHEN ends_with(n, ' licensed') THEN [regexp_replace(n, ' licensed$', '')] END AS x FROM {rows}n ANTI JOIN {rows}d USING (doc_id, i, j))),
{rows}x AS (SELECT doc_id, i, j, q, id FROM {rows}d UNION ALL SELECT * EXCLUDE (c) FROM (SELECT doc_id, i, j, q, v.id, c FROM {rows}e JOIN v ON v.s = {rows}e.s QUALIFY count(*) OVER (PARTITION BY doc_id, i, j) = c))"""

    return rf"""
WITH p AS (SELECT doc_id, unnest(range(len(x))) AS i, 0 AS j, unnest(x) AS s FROM (
    SELECT doc_id, string_split_regex(regexp_replace(text, '([.?])\s+', '\1' || chr(10) || chr(10), 'g'), '\r?\n\s*\n\s*') AS x FROM documents)),
k(s, id) AS (VALUES {known}), v(s, id) AS (VALUES {expressed}),
{ids_of('p')},
l AS (SELECT doc_id, i, unnest(range(len(x))) AS j, unnest(x) AS s FROM (SELECT doc_id, i, string_split_regex(s, '[\r\n]+') AS x FROM p ANTI JOIN px USING (doc_id, i))),
{ids_of('l')},
b AS (SELECT doc_id, list(id ORDER BY i, j, q) AS ids FROM (SELECT * FROM px UNION ALL SELECT * FROM lx) GROUP BY doc_id),
g AS (SELECT d.doc_id, coalesce(b.ids, []) AS ids FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, concat_ws(',', {first}) AS licenses FROM ({query})
"""


OP1_SQL = _op1_sql()
