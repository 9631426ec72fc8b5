"""The ordered license signatures.

Patterns match lower-case words one space apart. A rule is tried only in texts that hold
its keyword as a word. Tier 1 rules quote a grant or an identifier, tier 2 rules a full
name, tier 3 rules a hint; a smaller tier has priority.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    order: int
    tier: int
    label: str
    keyword: str
    pattern: str


#: Label and exact words of the phrases that count as they are.
BASE = [
    ("gpl", "gnu general public license", "gnu"),
    ("apache", "apache license", "apache"),
    ("cc-by", "cc by", "cc"),
    ("mit", "mit license", "mit"),
]

#: Label, keyword, pattern of the name, words of the identifier (None: it has none).
NAMES = [
    ("gpl-1.0", "gnu", r"gnu general public license (?:version |v )?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "gnu", r"gnu general public license (?:as published by the free software foundation )?(?:version |v )?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "gnu", r"gnu general public license (?:as published by the free software foundation )?(?:version |v )?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.0", "gnu", r"gnu (?:library|lesser) general public license (?:version |v )?2(?: 0)?(?! 1)", "lgpl 2 0"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license (?:version |v )?2 1", "lgpl 2 1"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public license (?:version |v )?3(?: 0)?", "lgpl 3 0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license (?:version |v )?3(?: 0)?", "agpl 3 0"),
    ("gfdl", "gnu", r"gnu free documentation license", "gfdl 1 3"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version |v )?2(?: 0)?", "apache 2 0"),
    ("mit-0", "mit", r"mit no attribution(?: license)?", "mit 0"),
    ("mit", "mit", r"(?:the )?mit (?:x11 )?license", "mit"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause) bsd license", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd license", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd license", "bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd license", "0bsd"),
    ("isc", "isc", r"isc license", "isc"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v )?2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license (?:version |v )?2(?: 0)?", "epl 2 0"),
    ("cddl-1.0", "cddl", r"common development and distribution license (?:cddl )?(?:version |v )?1(?: 0)?", "cddl 1 0"),
    ("cpl-1.0", "common", r"common public license (?:version |v )?1(?: 0)?", "cpl 1 0"),
    ("eupl-1.2", "european", r"european union public licen[cs]e (?:version |v )?1 2", "eupl 1 2"),
    ("cecill-2.1", "cecill", r"cecill (?:free software )?license (?:agreement )?(?:version |v )?2 1", "cecill 2 1"),
    ("artistic-1.0", "artistic", r"artistic license (?:version |v )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license (?:version |v )?2(?: 0)?", "artistic 2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", "libpng", r"libpng license", "libpng 2 0"),
    ("bsl-1.0", "boost", r"boost software license(?: (?:version |v )?1(?: 0)?)?", "bsl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: license)?", "wtfpl"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-2.0", "creative", r"creative commons attribution (?:license )?2 0", "cc by 2 0"),
    ("cc-by-3.0", "creative", r"creative commons attribution (?:license )?3 0", "cc by 3 0"),
    ("cc-by-4.0", "creative", r"creative commons attribution (?:license )?4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", "creative", r"creative commons attribution share ?alike (?:license )?3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "creative", r"creative commons attribution share ?alike (?:license )?4 0", "cc by sa 4 0"),
    ("cc-by-nc-3.0", "creative", r"creative commons attribution non ?commercial (?:license )?3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "creative", r"creative commons attribution non ?commercial (?:license )?4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "creative", r"creative commons attribution no ?deriv(?:s|atives) (?:license )?4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creative", r"creative commons attribution non ?commercial share ?alike (?:license )?4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creative", r"creative commons attribution non ?commercial no ?deriv(?:s|atives) (?:license )?4 0", "cc by nc nd 4 0"),
    ("odbl-1.0", "open", r"open (?:data commons open )?database license(?: (?:version |v )?1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", r"open data commons attribution license(?: (?:version |v )?1 0)?", "odc by 1 0"),
    ("pddl-1.0", "commons", r"open data commons public domain dedication(?: and)?(?: license)?", "pddl 1 0"),
    ("ofl-1.1", "sil", r"sil open font license(?: (?:version |v )?1 1)?", "ofl 1 1"),
    ("psf-2.0", "python", r"python software foundation license(?: (?:version |v )?2)?", "psf 2 0"),
    ("php-3.01", "php", r"php license(?: (?:version |v )?3 0?1)?", "php 3 01"),
    ("ruby", "ruby", r"ruby license", "ruby"),
    ("openssl", "openssl", r"openssl license", "openssl"),
    ("curl", "curl", r"curl license", "curl"),
    ("vim", "vim", r"vim license", "vim"),
    ("postgresql", "postgresql", r"postgresql license", "postgresql"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl"),
    ("upl-1.0", "universal", r"universal permissive license(?: (?:version |v )?1 0)?", "upl 1 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?license", "ncsa"),
    ("afl-3.0", "academic", r"academic free license(?: (?:version |v )?3 0)?", "afl 3 0"),
    ("osl-3.0", "open", r"open software license(?: (?:version |v )?3 0)?", "osl 3 0"),
    ("elastic-2.0", "elastic", r"elastic license(?: (?:version |v )?2 0)?", "elastic 2 0"),
    ("sspl-1.0", "server", r"server side public license(?: (?:version |v )?1)?", "sspl 1 0"),
    ("busl-1.1", "business", r"business source license(?: (?:version |v )?1 1)?", "busl 1 1"),
    ("openrail", "rail", r"(?:open rail|rail)(?: m)? license", None),
]

_GRANT = r"(?:licensed|released|distributed|published|provided|available|redistributed|covered)(?: [^ ]+){0,4} under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_NOTICE = r"(?:see|read|refer to|copy of) (?:the )?"

#: Tier, label, keyword, pattern of single rules.
SINGLE = [
    (1, "mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (1, "isc", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    (1, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "gpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license"),
    (1, "lgpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (1, "zlib", "altered", r"altered source versions must be plainly marked as such"),
    (1, "unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    (1, "wtfpl", "public", r"do what the fuck you want to public license"),
    (1, "bsl-1.0", "boost", r"distributed under the boost software license"),
    (1, "mpl-2.0", "mozilla", r"subject to the terms of the mozilla public license v 2 0"),
    (1, "public-domain", "domain", r"(?:dedicated|released|placed|dedicate|release|place) (?:[^ ]+ ){0,4}(?:to|into|in) the public domain"),
    (2, "public-domain", "domain", r"public domain"),
    (2, "gpl", "gpl", r"gpl(?: ?v ?[123])?(?: license)?"),
    (2, "lgpl", "lgpl", r"lgpl(?: ?v ?[23])?(?: license)?"),
    (2, "agpl", "agpl", r"agpl(?: ?v ?3)?(?: license)?"),
    (2, "bsd", "bsd", r"bsd (?:style )?license"),
    (2, "cc-by-sa", "cc", r"cc by sa"),
    (2, "cc-by-nc", "cc", r"cc by nc(?! sa| nd)"),
    (2, "cc-by-nd", "cc", r"cc by nd"),
    (2, "cc-by-nc-sa", "cc", r"cc by nc sa"),
    (2, "cc-by-nc-nd", "cc", r"cc by nc nd"),
    (2, "cc-by", "creative", r"creative commons attribution"),
    (2, "creative-commons", "creative", r"creative commons"),
    (3, "proprietary", "rights", r"all rights reserved"),
    (3, "proprietary", "proprietary", r"proprietary and confidential"),
    (3, "warranty-notice", "warranty", r"without warranty of any kind"),
    (3, "warranty-notice", "warranties", r"without warranties or conditions of any kind"),
    (3, "copyleft", "copyleft", r"copyleft"),
    (3, "open-source", "open", r"open source licen[cs]e"),
    (3, "license-file", "license", r"(?:license|licence|copying) (?:file|txt|md)"),
    (3, "license-file", "copying", r"copying (?:file|txt|md)"),
    (3, "royalty-free", "royalty", r"royalty free licen[cs]e"),
    (3, "end-user", "end", r"end user licen[cs]e agreement"),
]


def rules() -> list[Rule]:
    """All rules in their order; the base phrases come first in their tier."""
    found: list[tuple[int, str, str, str]] = [(2, label, word, phrase) for label, phrase, word in BASE]
    for label, word, name, identifier in NAMES:
        found.append((1, label, word, _GRANT + name))
        found.append((1, label, word, _NOTICE + name + r" for (?:more )?(?:details|the specific language)"))
        found.append((2, label, word, name))
        if identifier is not None:
            found.append((1, label, "spdx", rf"spdx license identifier {identifier}(?: only| or later)?"))
    found += SINGLE
    return [Rule(k, *rule[:2], rule[2], rf"(?<= )(?:{rule[3]})(?= )") for k, rule in enumerate(found)]
