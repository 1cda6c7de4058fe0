"""Licence signatures: label, priority, weight, keywords, pattern.

Patterns run over the words of a text, lower-cased and joined by one blank, and match whole words only. A rule runs where
all its keywords occur, so every match of its pattern must hold them all. Higher priority wins where one detection lies inside another: 9 exact notices and identifiers,
8 full licence names with version, 7 names, 6 characteristic sentences, 4 families, 2 weak hints.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


_LINES = r"""
mit|9|1.0|spdx mit|spdx license identifier mit
mit|7|0.9|mit|(?:the )?mit licen[sc]e
mit|7|0.9|mit|licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit
mit|6|0.95|permission granted charge|permission is hereby granted free of charge to any person obtaining a copy
mit|6|0.9|software provided kind|the software is provided as is without warranty of any kind express or implied including but not limited to
mit-0|8|1.0|mit|mit (?:0|no attribution)(?: licen[sc]e)?
x11|7|0.9|x11|x11 licen[sc]e
expat|7|0.9|expat|expat licen[sc]e
isc|9|1.0|spdx isc|spdx license identifier isc
isc|7|0.9|isc|isc licen[sc]e
isc|6|0.95|permission copy distribute|permission to use copy modify and or distribute this software for any purpose with or without fee
0bsd|8|1.0|0bsd|0bsd
0bsd|8|1.0|zero clause|(?:bsd )?zero clause (?:bsd )?licen[sc]e
bsd|4|0.7|bsd|bsd licen[sc]e
bsd|4|0.7|bsd|bsd style licen[sc]e
bsd|4|0.7|bsd|licen[sc]ed under (?:the )?bsd
bsd-1-clause|8|1.0|bsd clause|bsd (?:1|one) clause(?: licen[sc]e)?
bsd-2-clause|9|1.0|spdx bsd|spdx license identifier bsd 2 clause
bsd-2-clause|8|1.0|bsd clause|bsd (?:2|two) clause(?: licen[sc]e)?
bsd-2-clause|8|1.0|bsd clause|(?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause|8|1.0|simplified bsd|simplified bsd(?: licen[sc]e)?
bsd-2-clause|8|1.0|freebsd|freebsd licen[sc]e
bsd-3-clause|9|1.0|spdx bsd|spdx license identifier bsd 3 clause
bsd-3-clause|8|1.0|bsd clause|bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3-clause|8|1.0|bsd clause|(?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause|8|1.0|bsd|(?:new|revised|modified) bsd(?: licen[sc]e)?
bsd-3-clause|6|0.95|neither name endorse|neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote
bsd-4-clause|8|1.0|bsd clause|bsd (?:4|four) clause(?: licen[sc]e)?
bsd-4-clause|8|1.0|bsd|(?:original|old) bsd licen[sc]e
bsd-4-clause|6|0.95|advertising materials|all advertising materials mentioning features or use of this software must display
bsd|6|0.9|redistribution source binary|redistribution and use in source and binary forms with or without modification are permitted
bsd|6|0.8|redistributions source retain|redistributions of source code must retain the above copyright notice
bsd|6|0.8|redistributions binary reproduce|redistributions in binary form must reproduce the above copyright notice
apache-1.0|8|1.0|apache|apache (?:software )?licen[sc]e (?:version )?1 0
apache-1.1|8|1.0|apache|apache (?:software )?licen[sc]e (?:version )?1 1
apache-2.0|9|1.0|spdx apache|spdx license identifier apache 2 0
apache-2.0|8|1.0|apache|apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2.0|8|1.0|apache|apache 2 0(?: licen[sc]e)?
apache-2.0|8|1.0|asl|asl 2 0
apache-2.0|9|1.0|licensed apache except|licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0|8|1.0|www apache licenses|www apache org licenses license 2 0
apache|4|0.7|apache|apache (?:software )?licen[sc]e
mpl-1.0|8|1.0|mozilla public|mozilla public licen[sc]e (?:version |v )?1 0
mpl-1.1|8|1.0|mozilla public|mozilla public licen[sc]e (?:version |v )?1 1
mpl-2.0|8|1.0|mozilla public|mozilla public licen[sc]e (?:version |v )?2 0
mpl-1.1|8|1.0|mpl|mpl 1 1
mpl-2.0|8|1.0|mpl|mpl 2 0
mpl-2.0|9|1.0|source form subject mozilla|this source code form is subject to the terms of the mozilla public license v 2 0
mpl|4|0.7|mozilla public|mozilla public licen[sc]e
epl-1.0|8|1.0|eclipse public|eclipse public licen[sc]e (?:version |v )?1 0
epl-2.0|8|1.0|eclipse public|eclipse public licen[sc]e (?:version |v )?2 0
epl|4|0.7|eclipse public|eclipse public licen[sc]e
edl-1.0|8|1.0|eclipse distribution|eclipse distribution licen[sc]e(?: (?:version |v )?1 0)?
cpl-1.0|8|1.0|common public|common public licen[sc]e(?: (?:version )?1 0)?
ipl-1.0|8|1.0|ibm public|ibm public licen[sc]e(?: (?:version )?1 0)?
cddl-1.0|8|1.0|common development distribution|common development and distribution licen[sc]e(?: (?:version )?1 0)?
cddl-1.0|8|1.0|cddl|cddl 1 0
cddl-1.1|8|1.0|cddl|cddl 1 1
eupl|4|0.7|european union public|european union public licen[sc]e
eupl-1.1|8|1.0|eupl|eupl (?:v )?1 1
eupl-1.2|8|1.0|eupl|eupl (?:v )?1 2
artistic-1.0|8|1.0|artistic|artistic licen[sc]e (?:version )?1 0
artistic-2.0|8|1.0|artistic|artistic licen[sc]e (?:version )?2 0
artistic|4|0.7|artistic|artistic licen[sc]e
perl|7|0.9|same terms perl|(?:under )?the same terms as perl(?: itself)?
zlib|7|0.9|zlib|zlib licen[sc]e
zlib|7|0.9|zlib libpng|zlib libpng licen[sc]e
zlib|6|0.95|software provided implied event authors|this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng|7|0.9|libpng|libpng licen[sc]e
bsl-1.0|8|1.0|boost software|boost software licen[sc]e(?: version)?(?: 1 0)?
bsl-1.1|8|1.0|business source|business source licen[sc]e(?: (?:version )?1 1)?
psf-2.0|8|1.0|python software foundation|python software foundation licen[sc]e(?: version 2)?
psf-2.0|7|0.9|psf|psf licen[sc]e
python-2.0|8|1.0|python|python (?:2 0 )?licen[sc]e
php-3.0|8|1.0|php|php licen[sc]e (?:version )?3 0
php-3.01|8|1.0|php|php licen[sc]e (?:version )?3 01
php|4|0.7|php|php licen[sc]e
ruby|7|0.9|ruby|ruby licen[sc]e
openssl|7|0.9|openssl|openssl licen[sc]e
ssleay|7|0.9|ssleay|(?:original )?ssleay licen[sc]e
curl|7|0.9|curl|curl licen[sc]e
ncsa|8|1.0|illinois ncsa|university of illinois ncsa open source licen[sc]e
ncsa|7|0.9|ncsa|ncsa licen[sc]e
upl-1.0|8|1.0|universal permissive|universal permissive licen[sc]e(?: (?:version |v )?1 0)?
unlicense|9|1.0|spdx unlicense|spdx license identifier unlicense
unlicense|7|0.9|unlicense|(?:the )?unlicense
unlicense|6|0.95|free unencumbered public|this is free and unencumbered software released into the public domain
wtfpl|7|0.9|wtfpl|wtfpl
wtfpl|8|1.0|do what want public|do what the f\S+ you want to public licen[sc]e
beerware|7|0.9|beerware|beerware licen[sc]e
beerware|7|0.9|beer ware|beer ware licen[sc]e
afl-2.1|8|1.0|academic free|academic free licen[sc]e (?:version |v )?2 1
afl-3.0|8|1.0|academic free|academic free licen[sc]e (?:version |v )?3 0
afl|4|0.7|academic free|academic free licen[sc]e
osl-3.0|8|1.0|open software|open software licen[sc]e (?:version |v )?3 0
osl|4|0.7|open software|open software licen[sc]e
ofl-1.0|8|1.0|open font|(?:sil )?open font licen[sc]e (?:version )?1 0
ofl-1.1|8|1.0|open font|(?:sil )?open font licen[sc]e (?:version )?1 1
ofl|4|0.7|open font|(?:sil )?open font licen[sc]e
lppl|7|0.9|latex project public|latex project public licen[sc]e
qpl-1.0|8|1.0|q public|q public licen[sc]e(?: (?:version )?1 0)?
cecill-2.1|8|1.0|cecill|cecill (?:version |v )?2 1
cecill-b|8|1.0|cecill|cecill b
cecill-c|8|1.0|cecill|cecill c
cecill|4|0.7|cecill|cecill(?: licen[sc]e)?
mulan-psl-2.0|8|1.0|mulan permissive|mulan permissive software licen[sc]e(?: v2| version 2)?
ms-pl|8|1.0|microsoft public|microsoft public licen[sc]e
ms-rl|8|1.0|microsoft reciprocal|microsoft reciprocal licen[sc]e
apsl-2.0|8|1.0|apple public source|apple public source licen[sc]e(?: (?:version )?2 0)?
sspl-1.0|8|1.0|server side public|server side public licen[sc]e(?: (?:version |v )?1)?
elastic-2.0|8|1.0|elastic|elastic licen[sc]e (?:version )?2 0
elastic|4|0.7|elastic|elastic licen[sc]e
polyform|7|0.9|polyform|polyform (?:noncommercial|small business|shield|strict|free trial) licen[sc]e
commons-clause|8|1.0|commons clause|commons clause(?: licen[sc]e condition)?
odbl-1.0|8|1.0|open database|open database licen[sc]e(?: (?:version |v )?1 0)?
odbl-1.0|8|1.0|odbl|odbl(?: 1 0)?
odc-by-1.0|8|1.0|open data commons attribution|open data commons attribution licen[sc]e
odc-by-1.0|8|1.0|odc|odc by(?: 1 0)?
pddl-1.0|8|1.0|public domain dedication|(?:odc )?public domain dedication and licen[sc]e
dbcl-1.0|8|1.0|database contents|database contents licen[sc]e
ogl-uk-1.0|8|1.0|open government|open government licen[sc]e (?:version |v )?1 0
ogl-uk-2.0|8|1.0|open government|open government licen[sc]e (?:version |v )?2 0
ogl-uk-3.0|8|1.0|open government|open government licen[sc]e (?:version |v )?3 0
ogl|4|0.7|open government|open government licen[sc]e
etalab-2.0|8|1.0|open licen|(?:etalab )?open licen[sc]e (?:version )?2 0
etalab-2.0|8|1.0|licence ouverte|(?:etalab )?licence ouverte (?:version )?2 0
dl-de-by-2.0|8|1.0|datenlizenz|datenlizenz deutschland namensnennung(?: (?:version )?2 0)?
dl-de-zero-2.0|8|1.0|datenlizenz|datenlizenz deutschland zero(?: (?:version )?2 0)?
cdla-permissive|8|1.0|community data|community data licen[sc]e agreement permissive
cdla-sharing|8|1.0|community data|community data licen[sc]e agreement sharing
openrail|7|0.9|rail|(?:creativeml |bigscience )?(?:open ?rail)(?: m)?(?: licen[sc]e)?
free-art|7|0.9|free art|free art licen[sc]e
gfdl-1.1|8|1.0|free documentation|(?:gnu )?free documentation licen[sc]e (?:version )?1 1
gfdl-1.2|8|1.0|free documentation|(?:gnu )?free documentation licen[sc]e (?:version )?1 2
gfdl-1.3|8|1.0|free documentation|(?:gnu )?free documentation licen[sc]e (?:version )?1 3
gfdl|4|0.7|free documentation|(?:gnu )?free documentation licen[sc]e
gfdl|4|0.7|gfdl|gfdl
gpl-family|4|0.7|gnu general public|gnu general public licen[sc]e
gpl-family|6|0.95|free redistribute modify gnu|this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-family|6|0.8|gnu general public along|you should have received a copy of the gnu general public license along with
lgpl-family|4|0.7|lesser general public|(?:gnu )?lesser general public licen[sc]e
lgpl-family|4|0.7|library general public|(?:gnu )?library general public licen[sc]e
agpl-family|4|0.7|affero general public|(?:gnu )?affero general public licen[sc]e
gpl-classpath|8|1.0|classpath exception|(?:with )?(?:the )?classpath exception
gpl-linking|8|1.0|linking exception|(?:with )?(?:a )?linking exception
gcc-exception|8|1.0|gcc runtime|gcc runtime library exception
copyleft|2|0.4|copyleft|copyleft
cc|4|0.7|creative commons|creative commons(?: licen[sc]e)?
cc|4|0.7|creativecommons|creativecommons org licenses
cc-by|7|0.9|creative commons attribution|creative commons attribution(?: licen[sc]e)?
cc-by-sa|7|0.95|creative commons attribution share|creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nd|7|0.95|creative commons attribution deriv|creative commons attribution no ?deriv(?:s|atives)(?: licen[sc]e)?
cc-by-nc|7|0.95|creative commons attribution commercial|creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nc-sa|7|0.97|creative commons attribution commercial share|creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?
cc-by-nc-nd|7|0.97|creative commons attribution commercial deriv|creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: licen[sc]e)?
cc0-1.0|9|1.0|spdx cc0|spdx license identifier cc0 1 0
cc0-1.0|8|1.0|cc0|cc0(?: 1 0)?(?: universal)?
cc0-1.0|8|1.0|creative commons zero|creative commons zero(?: licen[sc]e)?
cc-pdm-1.0|8|1.0|public domain mark|(?:creative commons )?public domain mark(?: 1 0)?
public-domain|7|0.8|public domain|(?:released|placed|dedicated|put) (?:in ?to|in|to) the public domain
public-domain|4|0.6|public domain|(?:in )?the public domain
public-domain|4|0.5|gemeinfrei|gemeinfrei
public-domain|4|0.5|domaine public|(?:dans le )?domaine public
public-domain|4|0.5|dominio p|dominio p[uú]blico
copyright|4|0.5|copyright|copyright (?:c |© )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright|4|0.5|©|© (?:19|20)\d\d
copyright|2|0.3|copyright|copyright notice
copyright|2|0.3|copyrighted|copyrighted (?:material|work|content)
reserved-some|7|0.8|some rights reserved|some rights reserved
reserved-none|7|0.8|no rights reserved|no rights reserved
reserved-de|7|0.8|alle rechte vorbehalten|alle rechte vorbehalten
reserved-fr|7|0.8|tous droits r|tous droits r[ée]serv[ée]s
reserved-es|7|0.8|todos derechos reservados|todos los derechos reservados
proprietary|7|0.8|proprietary confidential|proprietary and confidential
proprietary|7|0.8|confidential proprietary|confidential and proprietary
proprietary|6|0.8|unauthorized this|unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|work|software)
proprietary|6|0.8|reproduced without permission|(?:may|must) not be reproduced (?:\S+ ){0,8}without (?:\S+ ){0,4}permission
proprietary|6|0.7|internal use only|for internal use only
noncommercial|4|0.6|non commercial|(?:for )?non commercial (?:use|purposes)(?: only)?
noncommercial|4|0.6|noncommercial|(?:for )?noncommercial (?:use|purposes)(?: only)?
noncommercial|4|0.6|not commercial|not for commercial (?:use|purposes)
research-only|6|0.7|research purposes only|(?:for )?(?:academic |scientific )?research purposes only
evaluation-only|6|0.7|evaluation purposes only|(?:for )?evaluation purposes only
no-ai-training|6|0.8|used train|(?:may|must|shall) not be used (?:to train|for (?:the )?training(?: of)?)(?: \S+){0,3}
no-redistribution|6|0.7|redistribut|(?:redistribution|redistributing)(?: \S+){0,3} (?:is )?(?:prohibited|forbidden)
no-redistribution|6|0.7|not redistributed|(?:may|must|shall) not be redistributed
shareware|4|0.6|shareware|shareware
freeware|4|0.6|freeware|freeware
eula|4|0.6|end user agreement|end user licen[sc]e agreement
eula|4|0.6|eula|eula
terms-of-use|2|0.4|terms of use|terms of use
terms-of-use|2|0.4|terms of service|terms of service
warranty-disclaimer|4|0.6|without any warranty|without any warranty
warranty-disclaimer|4|0.6|warranties merchantability|warranties of merchantability
warranty-disclaimer|4|0.6|fitness particular purpose|fitness for a particular purpose
liability-disclaimer|4|0.6|event liable|in no event (?:shall|will) (?:\S+ ){1,8}be liable
attribution-required|4|0.6|attribution required|attribution (?:is )?required
attribution-required|4|0.6|credit author|(?:must|should) (?:give )?credit the (?:original )?author
fair-use|4|0.5|fair use|fair use
fair-dealing|4|0.5|fair dealing|fair dealing
trademark|2|0.3|registered trademark|(?:is |are )?(?:a )?registered trademarks? of
patent-grant|4|0.6|patent licen|(?:grant of )?patent licen[sc]e
royalty-free|4|0.6|royalty free|royalty free
license-file|2|0.4|licen file|see (?:the )?(?:accompanying )?licen[sc]e file
license-file|2|0.4|see licen|see licen[sc]e (?:txt|md)
license-mention|2|0.3|under licen|(?:released|distributed|published|available|licen[sc]ed) under (?:the |a |an )?(?:\S+ ){0,4}licen[sc]e
license-mention|2|0.3|unter lizenz|unter (?:der |einer )?(?:\S+ ){0,3}lizenz
license-mention|2|0.3|sous licence|sous (?:la )?licence
license-mention|2|0.3|bajo licencia|bajo (?:la |una )?licencia
spdx|4|0.7|spdx|spdx license identifier
"""

#: Licences in several versions: short names, long name, versions.
_GNU = (
    ("gpl", "general public", ("1", "2", "3")),
    ("lgpl", "(?:lesser|library) general public", ("2", "2.1", "3")),
    ("agpl", "affero general public", ("1", "3")),
)
_CC = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _families() -> list[Rule]:
    rules = []
    for short, long, versions in _GNU:
        for v in versions:
            number = v.replace(".", " ") + ("(?: 0)?" if "." not in v else "")
            label = f"{short}-{v if '.' in v else v + '.0'}"
            names = (f"(?:gnu )?{long} licen[sc]e (?:as published by (?:the )?free software foundation )?(?:either )?(?:version |v )?{number}", f"(?:gnu )?{short} (?:version |v )?{number}", f"(?:gnu )?{short}v{v.replace('.', ' ')}")
            for keys, name in zip((("public", "general"), (short,), (f"{short}v",)), names, strict=True):
                rules.append(Rule(f"{label}-only", 8, 1.0, keys, f"{name}(?: only)?"))
                rules.append(Rule(f"{label}-or-later", 9, 1.0, (*keys, "later"), f"{name} or (?:\\S+ ){{0,4}}later(?: version)?"))
    for kind in _CC:
        words = kind.replace("-", " ")
        for v in _CC_VERSIONS:
            number = v.replace(".", " ")
            rules.append(Rule(f"cc-{kind}-{v}", 8, 1.0, ("cc", "by"), f"cc {words} {number}(?: (?:international|unported|generic))?"))
            rules.append(Rule(f"cc-{kind}-{v}", 8, 1.0, ("creativecommons",), f"creativecommons org licenses {words} {number}"))
            rules.append(Rule(f"cc-{kind}-{v}", 9, 1.0, ("spdx", "cc"), f"spdx license identifier cc {words} {number}"))
        if kind != "by":
            rules.append(Rule(f"cc-{kind}", 7, 0.9, ("cc", "by"), f"cc {words}"))
    return rules


def _written() -> list[Rule]:
    rows = (line.split("|", 4) for line in _LINES.strip().splitlines())
    return [Rule(label, int(priority), float(weight), tuple(keys.split()), pattern) for label, priority, weight, keys, pattern in rows]


RULES: tuple[Rule, ...] = (*_written(), *_families())
#: Phrases whose places are always reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_WEIGHT = 0.6
