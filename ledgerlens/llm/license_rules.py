"""Signature rules of license texts and notices.

A rule is a regular expression over a text's lower-cased words, joined by one
space. Its first word is literal: the keyword that a text must hold before the
expression is tried, so rules start with a word that is rare in other texts. RULES is ordered: of rules that match the same words with
the same priority, the first wins.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# The longest match of any rule, in words.
REACH = 28

TAG, NOTICE, TITLE, MENTION = 3, 2, 1, 0
CONFIDENCE = {TAG: 0.99, NOTICE: 0.95, TITLE: 0.85, MENTION: 0.6}


class Rule(NamedTuple):
    keyword: str
    pattern: str
    label: str
    priority: int
    base: bool


_V = r"(?: v(?:ersion)? ?)"
_LATER = r"(?: or (?:any )?(?:later|newer)(?: version)?| and later)"

# (label, first phrase that names it); every place counts, whatever surrounds it
BASE_PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Identifiers after "SPDX-License-Identifier:" or "license:", with their words
SPDX = """
0bsd; aal; afl-1.1; afl-2.1; afl-3.0; agpl-1.0; agpl-3.0; agpl-3.0-only; agpl-3.0-or-later; apache-1.0; apache-1.1;
apache-2.0; apsl-2.0; artistic-1.0; artistic-2.0; beerware; blueoak-1.0.0; bsd-1-clause; bsd-2-clause;
bsd-2-clause-patent; bsd-3-clause; bsd-3-clause-clear; bsd-4-clause; bsl-1.0; busl-1.1; bzip2-1.0.6; cal-1.0;
cc-by-1.0; cc-by-2.0; cc-by-2.5; cc-by-3.0; cc-by-4.0; cc-by-nc-2.0; cc-by-nc-3.0; cc-by-nc-4.0; cc-by-nc-nd-3.0;
cc-by-nc-nd-4.0; cc-by-nc-sa-3.0; cc-by-nc-sa-4.0; cc-by-nd-3.0; cc-by-nd-4.0; cc-by-sa-2.0; cc-by-sa-3.0;
cc-by-sa-4.0; cc0-1.0; cddl-1.0; cddl-1.1; cecill-2.0; cecill-2.1; cecill-b; cecill-c; cpal-1.0; cpl-1.0; curl;
ecl-2.0; efl-2.0; elastic-2.0; epl-1.0; epl-2.0; eupl-1.1; eupl-1.2; fsfap; ftl; gfdl-1.1; gfdl-1.2; gfdl-1.3;
gpl-1.0; gpl-2.0; gpl-2.0-only; gpl-2.0-or-later; gpl-3.0; gpl-3.0-only; gpl-3.0-or-later; hpnd; icu; ijg; intel;
ipl-1.0; isc; lgpl-2.0; lgpl-2.1; lgpl-2.1-only; lgpl-2.1-or-later; lgpl-3.0; lgpl-3.0-only; lgpl-3.0-or-later;
libpng; lppl-1.3c; mit; mit-0; mpl-1.0; mpl-1.1; mpl-2.0; ms-pl; ms-rl; mulanpsl-2.0; ncsa; nposl-3.0; odbl-1.0;
odc-by-1.0; ofl-1.0; ofl-1.1; openssl; osl-1.0; osl-2.1; osl-3.0; php-3.0; php-3.01; postgresql; psf-2.0;
python-2.0; qpl-1.0; rpl-1.5; ruby; sissl; sleepycat; spl-1.0; sspl-1.0; sunpro; tcl; ucl-1.0; unicode-3.0;
unlicense; upl-1.0; vim; w3c; wtfpl; x11; xnet; zlib; zpl-2.0; zpl-2.1
"""

# priority | label | expression; the label is the identifier of the license that the words name
WRITTEN = rf"""
2 | gpl-3.0-or-later | gnu general public license{_V}3(?: 0)?{_LATER}
2 | gpl-2.0-or-later | gnu general public license{_V}2(?: 0)?{_LATER}
2 | gpl-3.0 | gnu general public license{_V}3(?: 0)?
2 | gpl-2.0 | gnu general public license{_V}2(?: 0)?
2 | gpl-1.0 | gnu general public license{_V}1(?: 0)?
2 | gpl-3.0-or-later | gnu general public license as published by the free software foundation either version 3(?: 0)? of the license or(?: at your option)? any later
2 | gpl-2.0-or-later | gnu general public license as published by the free software foundation either version 2(?: 0)? of the license or(?: at your option)? any later
2 | gpl-2.0 | gnu general public license as published by the free software foundation version 2
1 | gpl | gnu general public licen[cs]e
1 | gpl | gnu gpl
2 | gpl-3.0-or-later | gnu gpl{_V}3(?: 0)?{_LATER}
2 | gpl-2.0-or-later | gnu gpl{_V}2(?: 0)?{_LATER}
2 | gpl-3.0 | gnu gpl(?:{_V}| )3(?: 0)?
2 | gpl-2.0 | gnu gpl(?:{_V}| )2(?: 0)?
2 | gpl-3.0 | gpl{_V}3(?: 0)?
2 | gpl-2.0 | gpl{_V}2(?: 0)?
2 | gpl-3.0 | gplv3
2 | gpl-2.0 | gplv2
2 | gpl-3.0 | gpl3
2 | gpl-2.0 | gpl2
2 | gpl-3.0-or-later | gplv3{_LATER}
2 | gpl-2.0-or-later | gplv2{_LATER}
2 | gpl-3.0 | www gnu org licenses gpl 3 0
2 | gpl-2.0 | www gnu org licenses (?:old licenses )?gpl 2 0
1 | gpl | www gnu org licenses gpl
1 | gpl | www gnu org copyleft gpl
2 | lgpl-3.0-or-later | gnu lesser general public license{_V}3(?: 0)?{_LATER}
2 | lgpl-2.1-or-later | gnu lesser general public license{_V}2 1{_LATER}
2 | lgpl-3.0 | gnu lesser general public license{_V}3(?: 0)?
2 | lgpl-2.1 | gnu lesser general public license{_V}2 1
2 | lgpl-2.0 | gnu library general public license{_V}2(?: 0)?
1 | lgpl | gnu lesser general public licen[cs]e
1 | lgpl | gnu library general public licen[cs]e
1 | lgpl | gnu lgpl
2 | lgpl-3.0 | gnu lgpl(?:{_V}| )3(?: 0)?
2 | lgpl-2.1 | gnu lgpl(?:{_V}| )2 1
2 | lgpl-3.0 | lgplv3
2 | lgpl-2.1 | lgplv2 1
2 | lgpl-2.1 | lgpl{_V}2 1
2 | lgpl-3.0 | lgpl{_V}3(?: 0)?
2 | lgpl-3.0 | www gnu org licenses lgpl 3 0
2 | lgpl-2.1 | www gnu org licenses (?:old licenses )?lgpl 2 1
2 | agpl-3.0-or-later | gnu affero general public license{_V}3(?: 0)?{_LATER}
2 | agpl-3.0 | gnu affero general public license{_V}3(?: 0)?
1 | agpl | gnu affero general public licen[cs]e
1 | agpl | affero general public licen[cs]e
1 | agpl | gnu agpl
2 | agpl-3.0 | gnu agpl(?:{_V}| )3(?: 0)?
2 | agpl-3.0 | agplv3
2 | agpl-3.0 | www gnu org licenses agpl 3 0
2 | gfdl-1.3 | gnu free documentation license{_V}1 3
2 | gfdl-1.2 | gnu free documentation license{_V}1 2
2 | gfdl-1.1 | gnu free documentation license{_V}1 1
1 | gfdl | gnu free documentation licen[cs]e
2 | gfdl | www gnu org (?:licenses|copyleft) fdl
2 | gcc-exception-3.1 | gcc runtime library exception(?:{_V}3 1)?
2 | classpath-exception-2.0 | classpath exception(?: 2 0)?
2 | linux-syscall-note | linux syscall note
2 | apache-2.0 | apache license{_V}2(?: 0)?
2 | apache-2.0 | apache license 2(?: 0)?
2 | apache-2.0 | apache software license{_V}2(?: 0)?
2 | apache-1.1 | apache software license{_V}1 1
2 | apache-1.1 | apache license{_V}1 1
2 | apache-1.0 | apache license{_V}1 0
1 | apache | apache software licen[cs]e
1 | apache | apache licen[cs]e
1 | apache | apache public licen[cs]e
2 | apache-2.0 | www apache org licenses license 2 0
2 | apache-1.1 | www apache org licenses license 1 1
1 | apache | www apache org licenses
2 | apache-2.0 | asl{_V}2(?: 0)?
2 | apache-2.0 | licensed under the apache license{_V}2(?: 0)?
2 | llvm-exception | llvm exceptions?
1 | mit | mit licen[cs]e
1 | mit | mit style licen[cs]e
1 | mit | mit x11 licen[cs]e
1 | mit | expat licen[cs]e
2 | mit | opensource org licenses mit
2 | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2 | mit | released under the mit licen[cs]e
2 | mit | licensed under the mit licen[cs]e
2 | mit-0 | mit no attribution
2 | x11 | x11 licen[cs]e
2 | bsd-3-clause | bsd 3 clause(?: licen[cs]e)?
2 | bsd-2-clause | bsd 2 clause(?: licen[cs]e)?
2 | bsd-4-clause | bsd 4 clause(?: licen[cs]e)?
2 | 0bsd | bsd zero clause(?: licen[cs]e)?
2 | bsd-3-clause | 3 clause bsd(?: licen[cs]e)?
2 | bsd-2-clause | 2 clause bsd(?: licen[cs]e)?
2 | bsd-4-clause | 4 clause bsd(?: licen[cs]e)?
2 | bsd-3-clause | new bsd licen[cs]e
2 | bsd-3-clause | modified bsd licen[cs]e
2 | bsd-3-clause | revised bsd licen[cs]e
2 | bsd-2-clause | simplified bsd licen[cs]e
2 | bsd-2-clause | freebsd licen[cs]e
2 | bsd-4-clause | original bsd licen[cs]e
1 | bsd | bsd licen[cs]e
1 | bsd | bsd style licen[cs]e
1 | bsd | berkeley software distribution licen[cs]e
2 | bsd-3-clause | opensource org licenses bsd 3 clause
2 | bsd-2-clause | opensource org licenses bsd 2 clause
1 | bsd | opensource org licenses bsd license
2 | bsd | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
2 | isc | isc licen[cs]e
2 | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 | hpnd | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
2 | zlib | zlib licen[cs]e
2 | zlib | zlib libpng licen[cs]e
2 | libpng | libpng licen[cs]e
2 | bsl-1.0 | boost software license(?:{_V}1 0)?
2 | bsl-1.0 | www boost org license 1 0
2 | mpl-2.0 | mozilla public license{_V}2(?: 0)?
2 | mpl-1.1 | mozilla public license{_V}1 1
2 | mpl-1.0 | mozilla public license{_V}1 0
2 | mpl-2.0 | mozilla public license 2 0
1 | mpl | mozilla public licen[cs]e
2 | mpl-2.0 | mozilla org mpl 2 0
2 | mpl-1.1 | mozilla org mpl 1 1
1 | mpl | www mozilla org mpl
2 | epl-2.0 | eclipse public license{_V}2(?: 0)?
2 | epl-1.0 | eclipse public license{_V}1(?: 0)?
2 | epl-2.0 | eclipse public license 2 0
1 | epl | eclipse public licen[cs]e
2 | epl-1.0 | www eclipse org legal epl v10
2 | epl-2.0 | www eclipse org legal epl 2 0
2 | edl-1.0 | eclipse distribution license(?:{_V}1 0)?
2 | cddl-1.0 | common development and distribution license{_V}1 0
2 | cddl-1.1 | common development and distribution license{_V}1 1
1 | cddl | common development and distribution licen[cs]e
2 | cpl-1.0 | common public license(?:{_V}1 0)?
2 | cpal-1.0 | common public attribution license(?:{_V}1 0)?
2 | ipl-1.0 | ibm public license(?:{_V}1 0)?
2 | eupl-1.2 | european union public licen[cs]e{_V}1 2
2 | eupl-1.1 | european union public licen[cs]e{_V}1 1
1 | eupl | european union public licen[cs]e
2 | cecill-2.1 | cecill{_V}2 1
2 | cecill-2.0 | cecill{_V}2(?: 0)?
2 | cecill-b | cecill b
2 | cecill-c | cecill c
1 | cecill | cecill licen[cs]e
2 | artistic-2.0 | artistic license(?:{_V}| )2(?: 0)?
2 | artistic-1.0 | artistic license(?:{_V}| )1(?: 0)?
1 | artistic | artistic licen[cs]e
1 | artistic | perl artistic licen[cs]e
2 | afl-3.0 | academic free license(?:{_V}| )3(?: 0)?
2 | afl-2.1 | academic free license(?:{_V}| )2 1
1 | afl | academic free licen[cs]e
2 | osl-3.0 | open software license(?:{_V}| )3(?: 0)?
1 | osl | open software licen[cs]e
2 | ofl-1.1 | sil open font license(?:(?:{_V}| )1 1)?
1 | ofl | open font licen[cs]e
2 | ofl-1.1 | scripts sil org ofl
2 | ecl-2.0 | educational community license(?:{_V}2 0)?
2 | ncsa | university of illinois ncsa open source licen[cs]e
2 | ncsa | ncsa open source licen[cs]e
2 | postgresql | postgresql licen[cs]e
2 | python-2.0 | python software foundation license(?:{_V}2)?
2 | psf-2.0 | psf license(?: agreement)?
2 | php-3.01 | php license(?:{_V}| )3 01
2 | php-3.0 | php license(?:{_V}| )3 0
1 | php | php licen[cs]e
2 | ruby | ruby licen[cs]e
2 | tcl | tcl tk licen[cs]e
2 | vim | vim licen[cs]e
2 | openssl | openssl licen[cs]e
2 | openssl | openssl toolkit licen[cs]e
2 | ssleay | original ssleay licen[cs]e
2 | curl | curl licen[cs]e
2 | icu | icu licen[cs]e
2 | unicode-3.0 | unicode license(?:{_V}3)?
2 | unicode-dfs-2016 | unicode inc license agreement
2 | w3c | w3c software (?:and document )?(?:notice and )?licen[cs]e
2 | zpl-2.1 | zope public license(?:{_V}| )2 1
1 | zpl | zope public licen[cs]e
2 | ms-pl | microsoft public licen[cs]e
2 | ms-rl | microsoft reciprocal licen[cs]e
2 | apsl-2.0 | apple public source license(?:{_V}2(?: 0)?)?
2 | sissl | sun industry standards source licen[cs]e
2 | spl-1.0 | sun public licen[cs]e
2 | bcl | oracle binary code licen[cs]e
2 | upl-1.0 | universal permissive license(?:{_V}1 0)?
2 | qpl-1.0 | q public licen[cs]e
2 | sleepycat | sleepycat licen[cs]e
2 | lppl-1.3c | latex project public license(?:{_V}1 3c?)?
2 | rpl-1.5 | reciprocal public license(?:{_V}| )1 5
2 | sspl-1.0 | server side public license(?:{_V}1)?
2 | busl-1.1 | business source license(?:{_V}| )?(?:1 1)?
2 | elastic-2.0 | elastic license(?:{_V}| )2(?: 0)?
2 | mulanpsl-2.0 | mulan psl{_V}2
2 | mulanpsl-2.0 | mulan permissive software license(?:{_V}2)?
2 | ijg | independent jpeg group s software
2 | ftl | freetype project licen[cs]e
2 | bzip2-1.0.6 | bzip2 licen[cs]e
2 | wtfpl | want to public licen[cs]e
2 | wtfpl | wtfpl licen[cs]e
2 | beerware | beer ?ware licen[cs]e
2 | beerware | beerware licen[cs]e
2 | unlicense | unlicense
2 | unlicense | unlicense org
2 | unlicense | unencumbered software released into the public domain
2 | cc0-1.0 | cc0 1 0(?: universal)?
1 | cc0 | cc0
2 | cc0-1.0 | creative commons zero(?:{_V}1 0)?
2 | cc0-1.0 | creativecommons org publicdomain zero 1 0
2 | public-domain | creativecommons org publicdomain mark 1 0
2 | cc-by-nc-nd-4.0 | cc by nc nd 4 0
2 | cc-by-nc-sa-4.0 | cc by nc sa 4 0
2 | cc-by-nc-4.0 | cc by nc 4 0
2 | cc-by-nd-4.0 | cc by nd 4 0
2 | cc-by-sa-4.0 | cc by sa 4 0
2 | cc-by-4.0 | cc by 4 0
2 | cc-by-nc-nd-3.0 | cc by nc nd 3 0
2 | cc-by-nc-sa-3.0 | cc by nc sa 3 0
2 | cc-by-nc-3.0 | cc by nc 3 0
2 | cc-by-nd-3.0 | cc by nd 3 0
2 | cc-by-sa-3.0 | cc by sa 3 0
2 | cc-by-3.0 | cc by 3 0
1 | cc-by-nc-nd | cc by nc nd
1 | cc-by-nc-sa | cc by nc sa
1 | cc-by-nc | cc by nc
1 | cc-by-nd | cc by nd
1 | cc-by-sa | cc by sa
1 | cc-by | cc by
2 | cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0
2 | cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0
2 | cc-by-nc-4.0 | creativecommons org licenses by nc 4 0
2 | cc-by-nd-4.0 | creativecommons org licenses by nd 4 0
2 | cc-by-sa-4.0 | creativecommons org licenses by sa 4 0
2 | cc-by-4.0 | creativecommons org licenses by 4 0
2 | cc-by-sa-3.0 | creativecommons org licenses by sa 3 0
2 | cc-by-3.0 | creativecommons org licenses by 3 0
2 | cc-by-nc-nd-4.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0
2 | cc-by-nc-sa-4.0 | creative commons attribution non ?commercial share ?alike 4 0
2 | cc-by-nc-4.0 | creative commons attribution non ?commercial 4 0
2 | cc-by-nd-4.0 | creative commons attribution no ?deriv(?:ative)?s 4 0
2 | cc-by-sa-4.0 | creative commons attribution share ?alike 4 0
2 | cc-by-4.0 | creative commons attribution 4 0
1 | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s
1 | cc-by-nc-sa | creative commons attribution non ?commercial share ?alike
1 | cc-by-nc | creative commons attribution non ?commercial
1 | cc-by-nd | creative commons attribution no ?deriv(?:ative)?s
1 | cc-by-sa | creative commons attribution share ?alike
1 | cc-by | creative commons attribution
0 | cc | creative commons licen[cs]e
2 | odbl-1.0 | open (?:data commons open )?database license(?:{_V}1 0)?
2 | odc-by-1.0 | open data commons attribution licen[cs]e
2 | pddl-1.0 | public domain dedication and licen[cs]e
2 | ogl-uk-3.0 | open government licen[cs]e(?:{_V}3 0)?
2 | etalab-2.0 | etalab open license 2 0
2 | dl-de-by-2.0 | datenlizenz deutschland namensnennung 2 0
1 | public-domain | public domain
2 | public-domain | dedicated to the public domain
2 | public-domain | placed in the public domain
2 | public-domain | released into the public domain
2 | openrail | openrail m? ?licen[cs]e
2 | openrail | bigscience open rail m licen[cs]e
2 | openrail | creativeml open ?rail m
2 | proprietary | rights reserved
2 | proprietary | proprietary and confidential
2 | proprietary | proprietary licen[cs]e
2 | proprietary | end user licen[cs]e agreement
2 | proprietary | unauthorized copying of this file
1 | commercial | commercial licen[cs]e
0 | unknown | licensed under the terms
0 | unknown | released under the terms
0 | unknown | license(?: txt| md| file)? for details
0 | unknown | license agreement
0 | unknown | license for the specific language governing permissions
"""


def _rules() -> list[Rule]:
    found = [Rule(phrase.split(" ")[0], phrase, label, TITLE, True) for label, phrase in BASE_PHRASES]
    for line in WRITTEN.strip().splitlines():
        priority, label, pattern = (part.strip() for part in line.split("|", 2))
        found.append(Rule(re.match("[a-z0-9]+", pattern)[0], pattern, label, int(priority), False))
    for name in SPDX.replace("\n", " ").split(";"):
        words = name.strip().replace("-", " ").replace(".", " ")
        found.append(Rule("spdx", f"spdx license identifiers? {words}", name.strip(), TAG, False))
        # A name that is one plain word may be any word behind "license".
        named = NOTICE if re.search("[0-9 ]", words) else MENTION
        found.append(Rule("license", f"license {words}", name.strip(), named, False))
    return found


RULES = _rules()
