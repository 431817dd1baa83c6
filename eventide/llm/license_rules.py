"""Licence signatures: ordered regex rules, each with the words that gate it.

The rules are written as families (label, spellings of the name, SPDX identifiers, address); every
family makes one rule for each way in which texts refer to a licence.  The order of ``RULES`` is
the priority: of two detections over the same place the earlier rule's stays.

A gate is never stricter than its regex: every word of it stands, without blanks, in all texts that
the regex matches, so line breaks between words do not matter.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int  # smaller is stronger
    keyword: str  # lower case, words between blanks, the rarest first; a text that lacks one of them is not searched
    pattern: str  # Java regex
    weight: float  # how sure a detection makes us


_V = r"[,\s]*(?:version|ver\.?|v\.?)?\s*"  # before a version number
_LATER = r"(?:\s*\(?or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?\)?|\s*\+)"
_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

# (label, name pattern, words in every spelling of the name, SPDX identifiers, address or None)
FAMILIES = [
    ("mit", r"(?:mit|expat)\s+(?:open\s+source\s+)?licen[sc]e", "licen", ["MIT", "MIT-0", "MIT-Modern-Variant"], r"opensource\.org/licenses?/mit"),
    ("apache-2.0", rf"apache\s+(?:software\s+)?licen[sc]e{_V}2(?:\.0)?", "apache licen", ["Apache-2.0"], r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", rf"apache\s+(?:software\s+)?licen[sc]e{_V}1\.1", "apache licen", ["Apache-1.1"], r"apache\.org/licenses/license-1\.1"),
    ("apache", r"apache\s+(?:software\s+)?licen[sc]e", "apache licen", ["Apache-1.0"], r"apache\.org/licenses"),
    ("agpl-3.0", rf"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?", "affero general public licen", ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], r"gnu\.org/licenses/agpl(?:-3\.0)?"),
    ("agpl", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e", "affero general public licen", ["AGPL-1.0"], r"affero\.org/oagpl"),
    ("lgpl-3.0", rf"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?", "general public licen", ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", rf"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e{_V}2\.1", "lesser general public licen", ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", rf"(?:gnu\s+)?library\s+general\s+public\s+licen[sc]e{_V}2(?:\.0)?", "library general public licen", ["LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later"], r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[sc]e", "general public licen", ["LGPLLR"], r"gnu\.org/(?:copyleft|licenses)/lesser"),
    ("gpl-3.0", rf"(?:gnu\s+)?general\s+public\s+licen[sc]e{_V}3(?:\.0)?", "general public licen", ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", rf"(?:gnu\s+)?general\s+public\s+licen[sc]e{_V}2(?:\.0)?", "general public licen", ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-1.0", rf"(?:gnu\s+)?general\s+public\s+licen[sc]e{_V}1(?:\.0)?", "general public licen", ["GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later"], r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl", r"(?:gnu\s+)?general\s+public\s+licen[sc]e", "general public licen", ["GPL-CC-1.0"], r"gnu\.org/(?:copyleft|licenses)/gpl"),
    ("gfdl", rf"(?:gnu\s+)?free\s+documentation\s+licen[sc]e(?:{_V}1\.[123])?", "free documentation licen", ["GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GFDL-1.3-or-later"], r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", r"(?:(?:2|two)[\s-]clause\s+bsd|bsd\s+(?:2|two)[\s-]clause|simplified\s+bsd|freebsd)\s+licen[sc]e", "bsd licen", ["BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-2-Clause-Views"], r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", r"(?:(?:3|three)[\s-]clause\s+bsd|bsd\s+(?:3|three)[\s-]clause|(?:new|modified|revised)\s+bsd)\s+licen[sc]e", "bsd licen", ["BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-3-Clause-LBNL"], r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", r"(?:(?:4|four)[\s-]clause\s+bsd|bsd\s+(?:4|four)[\s-]clause|original\s+bsd)\s+licen[sc]e", "bsd licen", ["BSD-4-Clause", "BSD-4-Clause-UC"], None),
    ("bsd", r"bsd[\s-](?:style\s+)?licen[sc]e", "bsd licen", ["0BSD", "BSD-1-Clause"], r"opensource\.org/licenses?/bsd-license"),
    ("isc", r"isc\s+licen[sc]e", "isc licen", ["ISC"], r"opensource\.org/licenses?/isc"),
    ("mpl-2.0", rf"mozilla\s+public\s+licen[sc]e{_V}2(?:\.0)?", "mozilla public licen", ["MPL-2.0", "MPL-2.0-no-copyleft-exception"], r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", rf"mozilla\s+public\s+licen[sc]e{_V}1\.1", "mozilla public licen", ["MPL-1.1"], r"mozilla\.org/(?:en-us/)?mpl/1\.1"),
    ("mpl", r"mozilla\s+public\s+licen[sc]e", "mozilla public licen", ["MPL-1.0"], r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl-2.0", rf"eclipse\s+public\s+licen[sc]e{_V}2(?:\.0)?", "eclipse public licen", ["EPL-2.0"], r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("epl-1.0", rf"eclipse\s+public\s+licen[sc]e(?:{_V}1(?:\.0)?)?", "eclipse public licen", ["EPL-1.0"], r"eclipse\.org/legal/epl-v10"),
    ("cddl", rf"common\s+development\s+and\s+distribution\s+licen[sc]e(?:{_V}1\.[01])?", "common development distribution licen", ["CDDL-1.0", "CDDL-1.1"], r"opensource\.org/licenses?/cddl"),
    ("cpl-1.0", rf"common\s+public\s+licen[sc]e(?:{_V}1\.0)?", "common public licen", ["CPL-1.0"], r"opensource\.org/licenses?/cpl1\.0"),
    ("eupl", rf"european\s+union\s+public\s+licen[sc]e(?:{_V}1\.[012])?", "european union public licen", ["EUPL-1.0", "EUPL-1.1", "EUPL-1.2"], r"joinup\.ec\.europa\.eu/[^\s]*eupl"),
    ("artistic-2.0", rf"artistic\s+licen[sc]e{_V}2(?:\.0)?", "artistic licen", ["Artistic-2.0"], r"opensource\.org/licenses?/artistic-2\.0"),
    ("artistic-1.0", rf"artistic\s+licen[sc]e(?:{_V}1(?:\.0)?)?", "artistic licen", ["Artistic-1.0", "Artistic-1.0-Perl"], r"opensource\.org/licenses?/artistic"),
    ("boost-1.0", rf"boost\s+software\s+licen[sc]e(?:{_V}1(?:\.0)?)?", "boost software licen", ["BSL-1.0"], r"boost\.org/license_1_0"),
    ("zlib", r"(?:zlib(?:/libpng)?|libpng)\s+licen[sc]e", "lib licen", ["Zlib", "Libpng", "libpng-2.0"], r"zlib\.net/zlib_license"),
    ("unlicense", r"(?:the\s+)?unlicen[sc]e", "unlicen", ["Unlicense"], r"unlicense\.org"),
    ("wtfpl", r"do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+licen[sc]e", "what want public licen", ["WTFPL"], r"wtfpl\.net"),
    ("python-2.0", rf"(?:python|psf)\s+(?:software\s+foundation\s+)?licen[sc]e(?:{_V}2(?:\.0)?)?", "licen", ["Python-2.0", "PSF-2.0"], r"docs\.python\.org/[^\s]*license"),
    ("php-3.01", rf"php\s+licen[sc]e(?:{_V}3\.0?1?)?", "php licen", ["PHP-3.0", "PHP-3.01"], r"php\.net/license"),
    ("ruby", r"ruby\s+licen[sc]e", "ruby licen", ["Ruby"], None),
    ("openssl", r"openssl\s+licen[sc]e", "openssl licen", ["OpenSSL"], r"openssl\.org/source/license"),
    ("postgresql", r"postgresql\s+licen[sc]e", "postgresql licen", ["PostgreSQL"], r"opensource\.org/licenses?/postgresql"),
    ("ofl-1.1", rf"(?:sil\s+)?open\s+font\s+licen[sc]e(?:{_V}1\.[01])?", "open font licen", ["OFL-1.0", "OFL-1.1"], r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", rf"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[sc]e(?:{_V}1\.0)?", "open database licen", ["ODbL-1.0"], r"opendatacommons\.org/licenses/odbl"),
    ("ms-pl", r"microsoft\s+public\s+licen[sc]e", "microsoft licen", ["MS-PL"], r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"microsoft\s+reciprocal\s+licen[sc]e", "microsoft licen", ["MS-RL"], r"opensource\.org/licenses?/ms-rl"),
    ("afl-3.0", rf"academic\s+free\s+licen[sc]e(?:{_V}3\.0)?", "academic free licen", ["AFL-2.1", "AFL-3.0"], r"opensource\.org/licenses?/afl-3\.0"),
    ("busl-1.1", rf"business\s+source\s+licen[sc]e(?:{_V}1\.1)?", "business source licen", ["BUSL-1.1"], r"mariadb\.com/bsl11"),
    ("sspl-1.0", rf"server\s+side\s+public\s+licen[sc]e(?:{_V}1(?:\.0)?)?", "server side public licen", ["SSPL-1.0"], r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", rf"elastic\s+licen[sc]e(?:{_V}2(?:\.0)?)?", "elastic licen", ["Elastic-2.0"], r"elastic\.co/licensing/elastic-license"),
]
# Creative Commons: (code, words that follow "attribution")
_CC = [("by", ""), ("by-sa", r"[\s-]*share[\s-]?alike"), ("by-nd", r"[\s-]*no[\s-]?deriv(?:ative)?s?(?:\s+works)?"),
       ("by-nc", r"[\s-]*non[\s-]?commercial"), ("by-nc-sa", r"[\s-]*non[\s-]?commercial[\s-]*share[\s-]?alike"),
       ("by-nc-nd", r"[\s-]*non[\s-]?commercial[\s-]*no[\s-]?deriv(?:ative)?s?(?:\s+works)?")]
_CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0")
# (label, words, pattern, weight): sentences of licence texts and notices
TEXTS = [
    ("mit", "permission hereby granted obtaining", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 1.0),
    ("mit", "restriction without software", r"to\s+deal\s+in\s+the\s+software\s+without\s+restriction", 0.9),
    ("isc", "permission modify distribute software purpose", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose", 1.0),
    ("bsd", "redistribution source binary forms", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", 0.9),
    ("bsd-3-clause", "endorse neither promote products", r"neither\s+the\s+name\s+of\s+(?s:.{1,120}?)endorse\s+or\s+promote\s+products", 0.95),
    ("bsd-4-clause", "advertising materials mentioning features", r"all\s+advertising\s+materials\s+mentioning\s+features", 0.95),
    ("apache-2.0", "licensed under apache version", r"licensed\s+under\s+the\s+apache\s+license,\s+version\s+2\.0\s+\(the\s+[\"“]license[\"”]\)", 1.0),
    ("gpl", "redistribute program free software", r"this\s+program\s+is\s+free\s+software[;:,]?\s+you\s+can\s+redistribute\s+it", 0.95),
    ("lgpl", "redistribute library free software", r"this\s+library\s+is\s+free\s+software[;:,]?\s+you\s+can\s+redistribute\s+it", 0.95),
    ("mpl-2.0", "source subject mozilla public license", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license", 1.0),
    ("zlib", "'as-is' software provided warranty", r"this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty", 0.95),
    ("unlicense", "unencumbered public domain", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", 1.0),
    ("public-domain", "domain public", r"(?:released\s+(?:in)?to|(?:is\s+)?(?:hereby\s+)?(?:placed\s+)?in)\s+the\s+public\s+domain", 0.8),
    ("proprietary", "reserved rights", r"all\s+rights\s+reserved", 0.5),
    ("proprietary", "confidential proprietary", r"proprietary\s+and\s+confidential", 0.8),
    ("warranty", "warranty without provided kind", r"provided\s+[\"“']?as\s+is[\"”']?,?\s+without\s+warranty\s+of\s+any\s+kind", 0.4),
]


def _rule(label, keyword, pattern, weight, priority):
    return Rule(label, priority, keyword, f"(?i){_B}(?:{pattern}){_E}", weight)


def _rules() -> list[Rule]:
    found: list[tuple] = []  # (label, words, pattern, weight), strongest first
    found += [t for t in TEXTS if t[3] >= 0.95]
    spdx = [(s, label) for label, _, _, ids, _ in FAMILIES for s in ids]
    spdx += [(f"CC-{code.upper()}-{v}", f"cc-{code}-{v}") for code, _ in _CC for v in _CC_VERSIONS] + [("CC0-1.0", "cc0-1.0")]
    found += [(label, "spdx-license-identifier:", r"spdx-license-identifier:\s*" + s.replace(".", r"\.").replace("+", r"\+") + r"(?![\w.+-]*[\w+-])", 1.0)
              for s, label in sorted(spdx, key=lambda x: (-len(x[0]), x[0]))]
    found += [(label, url.partition("/")[0].replace("\\", ""), r"(?:https?://)?(?:www\.)?" + url, 0.95) for label, _, _, _, url in FAMILIES if url]
    for code, words in _CC:
        for v in _CC_VERSIONS:
            dotted = v.replace(".", r"\.")
            found.append((f"cc-{code}-{v}", "creativecommons.org", rf"creativecommons\.org/licenses/{code}/{dotted}", 1.0))
            found.append((f"cc-{code}-{v}", "licensed under cc", rf"licensed\s+under\s+(?:a\s+)?cc[\s-]{code}[\s-]{dotted}", 1.0))
            found.append((f"cc-{code}-{v}", "commons creative attribution", rf"creative\s+commons\s+attribution{words}\s+{dotted}(?:\s+international|\s+unported)?(?:\s+licen[sc]e)?", 0.95))
        found.append((f"cc-{code}", "licensed under cc", rf"licensed\s+under\s+(?:a\s+)?cc[\s-]{code}", 0.8))
        found.append((f"cc-{code}", "commons creative attribution", rf"creative\s+commons\s+attribution{words}", 0.8))
    found.append(("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0", 1.0))
    found += [("cc0-1.0", words, name + r"(?:[\s-]1\.0)?(?:\s+licen[sc]e)?", 0.9)
              for words, name in (("cc0", "cc0"), ("commons creative zero", r"creative\s+commons\s+zero"))]
    lead = r"(?:(?:is|are)\s+)?(?:licensed|released|distributed|made\s+available)\s+under\s+(?:the\s+terms\s+of\s+)?(?:the\s+)?"
    found += [(label, key + " under", lead + name + f"{_LATER}?", 1.0) for label, name, key, _, _ in FAMILIES]
    found += [(label, key, name + f"{_LATER}?", 0.85) for label, name, key, _, _ in FAMILIES]
    found += [t for t in TEXTS if t[3] < 0.95]
    return [_rule(*f, priority=i) for i, f in enumerate(found)]


RULES = _rules()
#: A text that has none of these lacks a word of every rule and is not looked at.
ROOTS = tuple(sorted({"licen" if "licen" in r.keyword else r.keyword.split()[0] for r in RULES}))
