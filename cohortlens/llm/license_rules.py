"""Signature rules of the licence scan.

A rule is a label, a kind, a keyword that must occur in the lower-cased text before the expression is tried, and the
expression. ``FAMILIES`` states by hand, per licence, its identifiers, its names and the addresses of its text; each is
combined with the kinds of statement below. ``SENTENCES`` are expressions for sentences of licence texts and notices.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    kind: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


#: Kind of statement: priority (higher wins), confidence.
KINDS = {
    "tag": (90, 1.0),
    "address": (80, 0.95),
    "grant": (70, 0.95),
    "sentence": (60, 0.9),
    "name": (40, 0.7),
    "notice": (20, 0.4),
}

#: label: (identifiers, names, addresses, keyword). Expressions over lower-case text; a blank stands for any white space.
FAMILIES = {
    "mit": (["mit"], [r"mit license", r"expat license", r"x11 license"], [r"opensource\.org/licenses?/mit\b", r"mit-license\.org"]),
    "mit-0": (["mit-0"], [r"mit no attribution", r"mit-0"], [r"opensource\.org/licenses?/mit-0"]),
    "apache-1.1": (["apache-1.1"], [r"apache (?:software )?license,? (?:version |v)?1\.1"], [r"apache\.org/licenses/license-1\.1"]),
    "apache-2.0": (["apache-2.0"], [r"apache (?:software )?license,? ?(?:version |v)?2(?:\.0)?", r"apache-2\.0"], [r"apache\.org/licenses/license-2\.0"]),
    "gpl-1.0": (["gpl-1.0", "gpl-1.0-only", "gpl-1.0-or-later"], [r"gnu general public license,? (?:version |v)1", r"gplv1"], [r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"]),
    "gpl-2.0": (["gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"], [r"(?:gnu )?general public license,? (?:version |v)2", r"gpl ?v?2"], [r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"]),
    "gpl-3.0": (["gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"], [r"(?:gnu )?general public license,? (?:version |v)3", r"gpl ?v?3"], [r"gnu\.org/licenses/gpl-3\.0"]),
    "lgpl-2.0": (["lgpl-2.0", "lgpl-2.0-only", "lgpl-2.0-or-later"], [r"(?:gnu )?library general public license", r"lgpl ?v?2\.0"], [r"gnu\.org/licenses/old-licenses/lgpl-2\.0"]),
    "lgpl-2.1": (["lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"], [r"(?:gnu )?lesser general public license,? (?:version |v)2\.1", r"lgpl ?v?2\.1"], [r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"]),
    "lgpl-3.0": (["lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"], [r"(?:gnu )?lesser general public license,? (?:version |v)3", r"lgpl ?v?3"], [r"gnu\.org/licenses/lgpl-3\.0"]),
    "agpl-3.0": (["agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"], [r"(?:gnu )?affero general public license", r"agpl ?v?3"], [r"gnu\.org/licenses/agpl-3\.0"]),
    "gfdl": (["gfdl-1.1", "gfdl-1.2", "gfdl-1.3"], [r"gnu free documentation license", r"gfdl"], [r"gnu\.org/(?:copyleft|licenses)/fdl"]),
    "bsd-2-clause": (["bsd-2-clause"], [r"(?:simplified|2-clause|two-clause|freebsd) bsd license", r"bsd 2-clause", r"bsd-2-clause"], [r"opensource\.org/licenses?/bsd-2-clause"]),
    "bsd-3-clause": (["bsd-3-clause"], [r"(?:new|modified|revised|3-clause|three-clause) bsd license", r"bsd 3-clause", r"bsd-3-clause"], [r"opensource\.org/licenses?/bsd-3-clause"]),
    "bsd-4-clause": (["bsd-4-clause"], [r"(?:original|4-clause|four-clause) bsd license", r"bsd 4-clause"], [r"spdx\.org/licenses/bsd-4-clause"]),
    "bsd": (["bsd"], [r"bsd license", r"bsd-style license"], [r"opensource\.org/licenses?/bsd-license"]),
    "0bsd": (["0bsd"], [r"zero-clause bsd", r"bsd zero clause license"], [r"opensource\.org/licenses?/0bsd"]),
    "isc": (["isc"], [r"isc license"], [r"opensource\.org/licenses?/isc"]),
    "mpl-1.1": (["mpl-1.0", "mpl-1.1"], [r"mozilla public license,? (?:version |v)?1(?:\.[01])?"], [r"mozilla\.org/mpl/(?:1|mpl-1)"]),
    "mpl-2.0": (["mpl-2.0", "mpl-2.0-no-copyleft-exception"], [r"mozilla public license,? ?(?:version |v)?2(?:\.0)?", r"mpl ?v?2(?:\.0)?"], [r"mozilla\.org/(?:en-us/)?mpl/2\.0"]),
    "epl-1.0": (["epl-1.0"], [r"eclipse public license,? ?-? ?(?:version |v)?1\.0"], [r"eclipse\.org/(?:legal/)?epl-v10", r"eclipse\.org/org/documents/epl-v10"]),
    "epl-2.0": (["epl-2.0"], [r"eclipse public license,? ?-? ?(?:version |v)?2\.0"], [r"eclipse\.org/legal/epl-(?:2\.0|v20)"]),
    "edl-1.0": (["bsd-3-clause-edl"], [r"eclipse distribution license"], [r"eclipse\.org/org/documents/edl-v10"]),
    "cddl-1.0": (["cddl-1.0", "cddl-1.1"], [r"common development and distribution license", r"cddl"], [r"opensource\.org/licenses?/cddl"]),
    "cpl-1.0": (["cpl-1.0"], [r"common public license"], [r"opensource\.org/licenses?/cpl"]),
    "artistic-1.0": (["artistic-1.0", "artistic-1.0-perl"], [r"artistic license,? ?(?:version |v)?1\.0"], [r"opensource\.org/licenses?/artistic-license-1"]),
    "artistic-2.0": (["artistic-2.0"], [r"artistic license,? ?(?:version |v)?2\.0"], [r"opensource\.org/licenses?/artistic-license-2"]),
    "bsl-1.0": (["bsl-1.0"], [r"boost software license"], [r"boost\.org/license_1_0"]),
    "busl-1.1": (["busl-1.1"], [r"business source license"], [r"mariadb\.com/bsl11"]),
    "sspl-1.0": (["sspl-1.0"], [r"server side public license"], [r"mongodb\.com/licensing/server-side-public-license"]),
    "elastic-2.0": (["elastic-2.0"], [r"elastic license,? ?(?:version |v)?2(?:\.0)?"], [r"elastic\.co/licensing/elastic-license"]),
    "zlib": (["zlib", "zlib-acknowledgement"], [r"zlib license", r"zlib/libpng license"], [r"zlib\.net/zlib_license", r"opensource\.org/licenses?/zlib"]),
    "libpng": (["libpng", "libpng-2.0"], [r"libpng license", r"png reference library license"], [r"libpng\.org/pub/png/src/libpng-license"]),
    "unlicense": (["unlicense"], [r"the unlicense"], [r"unlicense\.org"]),
    "wtfpl": (["wtfpl"], [r"do what the fuck you want to public license", r"wtfpl"], [r"wtfpl\.net"]),
    "cc0-1.0": (["cc0-1.0"], [r"cc0(?: 1\.0)?(?: universal)?", r"creative commons zero"], [r"creativecommons\.org/publicdomain/zero"]),
    "pddm-1.0": (["cc-pddc"], [r"public domain dedication", r"creative commons public domain mark"], [r"creativecommons\.org/publicdomain/mark"]),
    "cc-by": (["cc-by-1.0", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0"], [r"creative commons attribution(?: [1-4]\.[05])?(?: international| unported| generic)?(?: public)? licen[sc]e", r"cc[ -]by(?:[ -][1-4]\.[05])?(?![ -]?(?:sa|nd|nc))"], [r"creativecommons\.org/licenses/by/"]),
    "cc-by-sa": (["cc-by-sa-2.0", "cc-by-sa-3.0", "cc-by-sa-4.0"], [r"creative commons attribution[- ]share ?-?alike", r"cc[ -]by[ -]sa(?:[ -][1-4]\.[05])?"], [r"creativecommons\.org/licenses/by-sa/"]),
    "cc-by-nd": (["cc-by-nd-2.0", "cc-by-nd-3.0", "cc-by-nd-4.0"], [r"creative commons attribution[- ]no ?-?deriv", r"cc[ -]by[ -]nd(?:[ -][1-4]\.[05])?"], [r"creativecommons\.org/licenses/by-nd/"]),
    "cc-by-nc": (["cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0"], [r"creative commons attribution[- ]non ?-?commercial(?![- ](?:share|no))", r"cc[ -]by[ -]nc(?:[ -][1-4]\.[05])?(?![ -]?(?:sa|nd))"], [r"creativecommons\.org/licenses/by-nc/"]),
    "cc-by-nc-sa": (["cc-by-nc-sa-2.0", "cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"], [r"creative commons attribution[- ]non ?-?commercial[- ]share ?-?alike", r"cc[ -]by[ -]nc[ -]sa(?:[ -][1-4]\.[05])?"], [r"creativecommons\.org/licenses/by-nc-sa/"]),
    "cc-by-nc-nd": (["cc-by-nc-nd-2.0", "cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"], [r"creative commons attribution[- ]non ?-?commercial[- ]no ?-?deriv", r"cc[ -]by[ -]nc[ -]nd(?:[ -][1-4]\.[05])?"], [r"creativecommons\.org/licenses/by-nc-nd/"]),
    "odbl-1.0": (["odbl-1.0"], [r"open (?:data commons )?(?:open )?database license"], [r"opendatacommons\.org/licenses/odbl"]),
    "odc-by-1.0": (["odc-by-1.0"], [r"open data commons attribution license"], [r"opendatacommons\.org/licenses/by"]),
    "pddl-1.0": (["pddl-1.0"], [r"open data commons public domain dedication"], [r"opendatacommons\.org/licenses/pddl"]),
    "ogl": (["ogl-uk-1.0", "ogl-uk-2.0", "ogl-uk-3.0"], [r"open government licen[sc]e"], [r"nationalarchives\.gov\.uk/doc/open-government-licence"]),
    "ofl-1.1": (["ofl-1.0", "ofl-1.1"], [r"sil open font license", r"open font license"], [r"scripts\.sil\.org/ofl", r"openfontlicense\.org"]),
    "python-2.0": (["python-2.0", "psf-2.0"], [r"python software foundation license", r"psf license"], [r"python\.org/(?:psf/)?license"]),
    "php-3.01": (["php-3.0", "php-3.01"], [r"php license"], [r"php\.net/license/3_0"]),
    "postgresql": (["postgresql"], [r"postgresql licen[sc]e"], [r"postgresql\.org/about/licen[sc]e"]),
    "openssl": (["openssl"], [r"openssl license"], [r"openssl\.org/source/license"]),
    "ruby": (["ruby"], [r"ruby license"], [r"ruby-lang\.org/en/about/license"]),
    "vim": (["vim"], [r"vim license"], [r"vimhelp\.org/uganda"]),
    "curl": (["curl"], [r"curl license"], [r"curl\.se/docs/copyright"]),
    "ncsa": (["ncsa"], [r"university of illinois/ncsa open source license", r"ncsa license"], [r"opensource\.org/licenses?/ncsa"]),
    "afl-3.0": (["afl-2.1", "afl-3.0"], [r"academic free license"], [r"opensource\.org/licenses?/afl-3\.0"]),
    "osl-3.0": (["osl-2.1", "osl-3.0"], [r"open software license"], [r"opensource\.org/licenses?/osl-3\.0"]),
    "eupl": (["eupl-1.1", "eupl-1.2"], [r"european union public licen[sc]e"], [r"joinup\.ec\.europa\.eu/.{0,40}eupl"]),
    "cecill": (["cecill-2.0", "cecill-2.1", "cecill-b", "cecill-c"], [r"cecill(?:-[bc])? licen[sc]e"], [r"cecill\.info/licences"]),
    "ms-pl": (["ms-pl"], [r"microsoft public license"], [r"opensource\.org/licenses?/ms-pl"]),
    "ms-rl": (["ms-rl"], [r"microsoft reciprocal license"], [r"opensource\.org/licenses?/ms-rl"]),
    "upl-1.0": (["upl-1.0"], [r"universal permissive license"], [r"opensource\.org/licenses?/upl"]),
    "qpl-1.0": (["qpl-1.0"], [r"q public license"], [r"opensource\.org/licenses?/qpl-1\.0"]),
    "ipl-1.0": (["ipl-1.0"], [r"ibm public license"], [r"opensource\.org/licenses?/ibmpl"]),
    "w3c": (["w3c", "w3c-20150513"], [r"w3c software (?:notice and )?(?:and document )?license"], [r"w3\.org/consortium/legal/.{0,20}copyright-software"]),
    "unicode": (["unicode-dfs-2016", "unicode-3.0"], [r"unicode license", r"unicode, inc\. license agreement"], [r"unicode\.org/(?:copyright|license)"]),
    "hippocratic": (["hippocratic-2.1"], [r"hippocratic license"], [r"firstdonoharm\.dev"]),
    "commons-clause": (["commons-clause"], [r"commons clause"], [r"commonsclause\.com"]),
    "llama": (["llama2", "llama3"], [r"llama [23](?:\.\d)? community license"], [r"llama\.com/llama[\d_]*/license", r"ai\.meta\.com/llama/license"]),
    "openrail": (["openrail", "bigscience-bloom-rail-1.0"], [r"(?:creativeml )?open ?rail(?:\+\+)?-m", r"responsible ai license"], [r"licenses\.ai"]),
}

#: Keyword of a family where it is not the first word of its label.
KEYWORDS = {
    "mit": {r"expat license": "expat", r"x11 license": "x11"},
    "gfdl": {r"gnu free documentation license": "free documentation", r"gfdl": "gfdl"},
}

#: (label, kind, keyword, expression): sentences of licence texts, grants and notices.
SENTENCES = [
    ("mit", "sentence", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "sentence", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "sentence", "sublicense", r"use, copy, modify, merge, publish, distribute, sublicense,? and/or sell"),
    ("isc", "sentence", "with or without fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", "sentence", "redistribution", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd", "sentence", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "sentence", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "sentence", "endorse or promote", r"neither the names? of .{1,80} nor the names of (?:its|their) contributors may be used to endorse or promote"),
    ("bsd-4-clause", "sentence", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "sentence", "apache license", r"licensed under the apache license, version 2\.0"),
    ("apache-2.0", "sentence", "in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "sentence", "distributed on an", r"software distributed under the license is distributed on an \"?as is\"? basis"),
    ("apache", "grant", "apache", r"licen[sc]ed under (?:the )?apache licen[sc]e"),
    ("gpl", "sentence", "free software", r"this (?:program|library|file|software) is free software[;:,]? you can redistribute it and/or modify it"),
    ("gpl", "sentence", "general public license", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "sentence", "lesser general public license", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "sentence", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gpl", "grant", "general public license", r"licen[sc]ed under (?:the )?(?:terms of the )?(?:gnu )?general public license"),
    ("gpl", "name", "gnu gpl", r"gnu gpl"),
    ("lgpl", "name", "gnu lgpl", r"gnu lgpl"),
    ("gpl", "notice", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2.0", "sentence", "mozilla public", r"subject to the terms of the mozilla public license,? v\. 2\.0"),
    ("epl-1.0", "sentence", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl-1.0", "sentence", "boost", r"distributed under the boost software license, version 1\.0"),
    ("zlib", "sentence", "express or implied", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", "sentence", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "sentence", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "sentence", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc-by", "grant", "cc by", r"licen[sc]ed under (?:a )?cc[ -]by(?:[ -][1-4]\.[05])?(?![ -]?(?:sa|nd|nc))"),
    ("cc-by", "sentence", "creative commons", r"this work is licensed under (?:a|the) creative commons attribution [1-4]\.[05]"),
    ("creative-commons", "name", "creative commons", r"creative commons"),
    ("public-domain", "notice", "public domain", r"(?:is|are|placed|released|dedicated) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "notice", "all rights reserved", r"all rights reserved"),
    ("copyright", "notice", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d"),
    ("copyright", "notice", "©", r"© ?(?:19|20)\d\d"),
    ("warranty-disclaimer", "notice", "warranty", r"provided \"?as is\"?,? without warranty of any kind"),
    ("proprietary", "notice", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "notice", "unauthorized copying", r"unauthorized copying of this (?:file|software|document)"),
    ("non-commercial", "notice", "non-commercial", r"for (?:personal,? )?non-commercial use only"),
    ("no-derivatives", "notice", "derivative works", r"no derivative works"),
    ("eula", "notice", "end user license agreement", r"end user license agreement"),
    ("eula", "notice", "end-user license agreement", r"end-user license agreement"),
    ("share-alike", "notice", "alike", r"distribute .{0,60} under the same license"),
    ("license-file", "notice", "license file", r"see (?:the )?(?:accompanying |included )?license file"),
    ("license-file", "notice", "license.txt", r"license\.txt"),
    ("license-file", "notice", "copying", r"see (?:the file )?copying for (?:details|license)"),
]

#: Statements around a name: kind, text before and after, keyword of its own.
GRANTS = r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the |an? )?"


def _plain_keyword(label: str, pattern: str) -> str:
    """Longest run of plain characters of an expression: it occurs wherever the expression matches."""
    import re

    bare = re.sub(r"\(\?[^()]*(?:\([^()]*\)[^()]*)*\)\??", "\0", pattern)
    bare = re.sub(r"\[[^\]]*\]\??", "\0", bare)
    bare = re.sub(r"\\\.", ".", bare)
    bare = re.sub(r"\\[a-zA-Z]|.[?*]|[.]\{[^}]*\}|[|+^$()]", "\0", bare)
    runs = [r.strip() for part in bare.split("\0") for r in part.split(" ")]
    return max(runs, key=len)


def rules() -> list[Rule]:
    """All rules in order of priority, then of statement."""
    out = []

    def add(label: str, kind: str, keyword: str, pattern: str) -> None:
        edge = r"(?<![a-z0-9])" if pattern[0].isalnum() or pattern[0] in "([" else ""
        # One word of the keyword: white space in a text may be of any kind.
        word = max(keyword.split(), key=len)
        # Runs give nothing back: two of them side by side would try every cut of a long run of blanks.
        blank = pattern.replace("[ -]", r"[\s-]").replace(" ?", r"\s*+").replace(" ", r"\s++")
        out.append(Rule(label, kind, *KINDS[kind], word, edge + blank))

    for label, (identifiers, names, addresses) in FAMILIES.items():
        for i in identifiers:
            add(label, "tag", "spdx-license-identifier", r"spdx-license-identifier: ?" + i.replace(".", r"\.") + r"(?![a-z0-9.-])")
            add(label, "tag", "license", r"license[\"']?(?: ?[:=] ?)[\"']" + i.replace(".", r"\.") + r"[\"']")
        for a in addresses:
            add(label, "address", _plain_keyword(label, a), a)
        for n in names:
            keyword = KEYWORDS.get(label, {}).get(n) or _plain_keyword(label, n)
            add(label, "grant", keyword, GRANTS + n)
            add(label, "name", keyword, n + r"(?![a-z0-9])")
    for label, kind, keyword, pattern in SENTENCES:
        add(label, kind, keyword, pattern)
    return sorted(out, key=lambda r: -r.priority)
