"""Hand-written licence signatures, one to a line: licence | priority | keyword | pattern.

A line's pattern is tried only on a text that holds its keyword (lower case, gaps as one space). A
space in a pattern stands for any run of white space and comment marks. Higher
priorities are more specific. Patterns ignore case.
"""

RULES = r"""
Apache-2.0 | 90 | apache | SPDX-License-Identifier: Apache-2\.0\b
Apache-1.1 | 90 | apache | SPDX-License-Identifier: Apache-1\.1\b
Apache-1.0 | 90 | apache | SPDX-License-Identifier: Apache-1\.0\b
Apache-2.0 | 80 | apache | licensed under (?:the )?Apache (?:Software )?License,? (?:Version |v\.? ?)?2(?:\.0)?
Apache-2.0 | 70 | apache | Apache (?:Software )?License,? (?:Version |v\.? ?)?2(?:\.0)?
Apache-2.0 | 70 | apache | Apache License Version 2\.0, January 2004
Apache-2.0 | 75 | apache | www\.apache\.org/licenses/LICENSE-2\.0
Apache-2.0 | 65 | apache | \bApache-2\.0\b
Apache-2.0 | 60 | apache | \bASL ?2\.0\b.{0,20}apache|apache.{0,20}\bASL ?2\.0\b
Apache-1.1 | 70 | apache | Apache (?:Software )?License,? (?:Version |v\.? ?)?1\.1
Apache-1.0 | 70 | apache | Apache (?:Software )?License,? (?:Version |v\.? ?)?1\.0
Apache-any | 40 | apache | (?:licensed|released|distributed|available) under (?:the )?Apache(?: Software)? License
Apache-any | 30 | apache | Apache(?: Software)? License
MIT | 90 | spdx | SPDX-License-Identifier: MIT\b(?!-)
MIT-0 | 90 | spdx | SPDX-License-Identifier: MIT-0\b
MIT | 80 | mit license | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of (?:the )?)?MIT License
MIT | 80 | mit licence | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of (?:the )?)?MIT Licence
MIT | 60 | mit license | \b(?:The )?MIT License\b
MIT | 60 | mit licence | \b(?:The )?MIT Licence\b
MIT | 55 | licensed | \bMIT[- ]licensed\b
MIT | 60 | opensource.org | opensource\.org/licenses/mit(?:-license)?(?:\.php|\.html)?\b
MIT | 75 | permission is hereby granted | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | 50 | substantial portions | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
X11 | 85 | x consortium | Except as contained in this notice, the name of the X Consortium shall not be used
X11 | 60 | x11 | \bX11 License\b
Expat | 60 | expat | \bExpat License\b
ISC | 90 | spdx | SPDX-License-Identifier: ISC\b
ISC | 80 | isc license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?ISC License
ISC | 60 | isc license | \bISC License\b
ISC | 75 | permission to use, copy | Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
0BSD | 90 | 0bsd | SPDX-License-Identifier: 0BSD\b
0BSD | 60 | zero-clause bsd | \bZero-Clause BSD\b
BSD-2-Clause | 90 | bsd-2-clause | SPDX-License-Identifier: BSD-2-Clause\b(?!-)
BSD-2-Clause-Patent | 90 | bsd-2-clause-patent | SPDX-License-Identifier: BSD-2-Clause-Patent\b
BSD-3-Clause | 90 | bsd-3-clause | SPDX-License-Identifier: BSD-3-Clause\b(?!-)
BSD-3-Clause-Clear | 90 | bsd-3-clause-clear | SPDX-License-Identifier: BSD-3-Clause-Clear\b
BSD-4-Clause | 90 | bsd-4-clause | SPDX-License-Identifier: BSD-4-Clause\b
BSD-2-Clause | 70 | bsd | \bBSD[- ]2[- ]Clause(?: License)?\b
BSD-2-Clause | 70 | 2-clause bsd | \b2-Clause BSD(?: License)?\b
BSD-2-Clause | 70 | simplified bsd | \bSimplified BSD License\b
BSD-2-Clause | 70 | freebsd license | \bFreeBSD License\b
BSD-3-Clause | 70 | bsd | \bBSD[- ]3[- ]Clause(?: License)?\b
BSD-3-Clause | 70 | 3-clause bsd | \b3-Clause BSD(?: License)?\b
BSD-3-Clause | 70 | new bsd | \bNew BSD License\b
BSD-3-Clause | 70 | modified bsd | \bModified BSD License\b
BSD-3-Clause | 70 | revised bsd | \bRevised BSD License\b
BSD-4-Clause | 70 | bsd | \bBSD[- ]4[- ]Clause(?: License)?\b
BSD-4-Clause | 70 | original bsd | \bOriginal BSD License\b
BSD-4-Clause | 80 | advertising materials | All advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-3-Clause | 80 | endorse or promote | Neither the name of .{1,120} nor the names of its contributors may be used to endorse or promote products derived
BSD-any | 65 | redistribution and use | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD-any | 40 | bsd | (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?BSD(?:[- ]style)? License
BSD-any | 30 | bsd | \bBSD(?:[- ]style)? License\b
GPL-2.0-only | 90 | gpl-2.0 | SPDX-License-Identifier: GPL-2\.0(?:-only)?\b(?![-+.])
GPL-2.0-or-later | 92 | gpl-2.0 | SPDX-License-Identifier: GPL-2\.0(?:-or-later|\+)
GPL-3.0-only | 90 | gpl-3.0 | SPDX-License-Identifier: GPL-3\.0(?:-only)?\b(?![-+.])
GPL-3.0-or-later | 92 | gpl-3.0 | SPDX-License-Identifier: GPL-3\.0(?:-or-later|\+)
GPL-1.0-or-later | 92 | gpl-1.0 | SPDX-License-Identifier: GPL-1\.0(?:-or-later|\+)
GPL-2.0-or-later | 88 | general public license | GNU General Public License as published by the Free Software Foundation; either version 2(?: of the License)?,? or \(?at your option\)? any later version
GPL-3.0-or-later | 88 | general public license | GNU General Public License as published by the Free Software Foundation,? either version 3(?: of the License)?,? or \(?at your option\)? any later version
GPL-1.0-or-later | 88 | general public license | GNU General Public License as published by the Free Software Foundation; either version 1,? or \(?at your option\)? any later version
GPL-2.0-only | 86 | general public license | GNU General Public License(?:,)? version 2(?: only)? as published by the Free Software Foundation
GPL-3.0-only | 80 | general public license | (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?GNU General Public License,? (?:version |v\.? ?)3(?:\.0)?
GPL-2.0-only | 80 | general public license | (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?GNU General Public License,? (?:version |v\.? ?)2(?:\.0)?
GPL-3.0-only | 70 | general public license | GNU General Public License,? (?:version |v\.? ?)3(?:\.0)?
GPL-2.0-only | 70 | general public license | GNU General Public License,? (?:version |v\.? ?)2(?:\.0)?
GPL-1.0-only | 70 | general public license | GNU General Public License,? (?:version |v\.? ?)1(?:\.0)?
GPL-3.0-only | 60 | gpl | (?<![AL])\bGPL ?-?(?:version |v\.? ?)?3(?:\.0)?\b
GPL-2.0-only | 60 | gpl | (?<![AL])\bGPL ?-?(?:version |v\.? ?)?2(?:\.0)?\b
GPL-3.0-or-later | 62 | gpl | (?<![AL])\bGPL ?-?(?:version |v\.? ?)?3(?:\.0)?(?:\+| or (?:any )?later)
GPL-2.0-or-later | 62 | gpl | (?<![AL])\bGPL ?-?(?:version |v\.? ?)?2(?:\.0)?(?:\+| or (?:any )?later)
GPL-any | 40 | general public license | (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?GNU General Public License
GPL-any | 30 | general public license | GNU General Public License
GPL-any | 30 | gnu.org | gnu\.org/licenses/gpl(?:\.html|\.txt)?\b
GPL-3.0-only | 65 | gnu.org | gnu\.org/licenses/gpl-3\.0
GPL-2.0-only | 65 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
GPL-2.0-with-classpath | 85 | classpath exception | \bClasspath Exception\b
GPL-with-linking | 70 | linking exception | \blinking exception\b
LGPL-2.0-only | 90 | lgpl-2.0 | SPDX-License-Identifier: LGPL-2\.0(?:-only)?\b(?![-+.])
LGPL-2.0-or-later | 92 | lgpl-2.0 | SPDX-License-Identifier: LGPL-2\.0(?:-or-later|\+)
LGPL-2.1-only | 90 | lgpl-2.1 | SPDX-License-Identifier: LGPL-2\.1(?:-only)?\b(?![-+.])
LGPL-2.1-or-later | 92 | lgpl-2.1 | SPDX-License-Identifier: LGPL-2\.1(?:-or-later|\+)
LGPL-3.0-only | 90 | lgpl-3.0 | SPDX-License-Identifier: LGPL-3\.0(?:-only)?\b(?![-+.])
LGPL-3.0-or-later | 92 | lgpl-3.0 | SPDX-License-Identifier: LGPL-3\.0(?:-or-later|\+)
LGPL-2.1-or-later | 88 | lesser general public | GNU Lesser General Public License as published by the Free Software Foundation; either version 2\.1 of the License,? or \(?at your option\)? any later version
LGPL-3.0-or-later | 88 | lesser general public | GNU Lesser General Public License as published by the Free Software Foundation[;,] either version 3 of the License,? or \(?at your option\)? any later version
LGPL-2.0-or-later | 88 | library general public | GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License,? or \(?at your option\)? any later version
LGPL-2.1-only | 75 | lesser general public | GNU Lesser General Public License,? (?:version |v\.? ?)2\.1
LGPL-3.0-only | 75 | lesser general public | GNU Lesser General Public License,? (?:version |v\.? ?)3(?:\.0)?
LGPL-2.0-only | 75 | library general public | GNU Library General Public License,? (?:version |v\.? ?)2(?:\.0)?
LGPL-2.1-only | 65 | lgpl | \bLGPL ?-?(?:version |v\.? ?)?2\.1\b
LGPL-3.0-only | 65 | lgpl | \bLGPL ?-?(?:version |v\.? ?)?3(?:\.0)?\b
LGPL-any | 45 | lesser general public | GNU Lesser General Public License
LGPL-any | 45 | library general public | GNU Library General Public License
LGPL-any | 35 | lgpl | \bLGPL\b
AGPL-3.0-only | 90 | agpl-3.0 | SPDX-License-Identifier: AGPL-3\.0(?:-only)?\b(?![-+.])
AGPL-3.0-or-later | 92 | agpl-3.0 | SPDX-License-Identifier: AGPL-3\.0(?:-or-later|\+)
AGPL-3.0-or-later | 88 | affero general public | GNU Affero General Public License as published by the Free Software Foundation,? either version 3 of the License,? or \(?at your option\)? any later version
AGPL-3.0-only | 75 | affero general public | GNU Affero General Public License,? (?:version |v\.? ?)3(?:\.0)?
AGPL-1.0-only | 75 | affero general public | Affero General Public License,? (?:version |v\.? ?)1(?:\.0)?
AGPL-3.0-only | 65 | agpl | \bAGPL ?-?(?:version |v\.? ?)?3(?:\.0)?\b
AGPL-any | 45 | affero general public | (?:GNU )?Affero General Public License
AGPL-any | 35 | agpl | \bAGPL\b
GFDL-1.1 | 75 | free documentation license | GNU Free Documentation License,? (?:version |v\.? ?)1\.1
GFDL-1.2 | 75 | free documentation license | GNU Free Documentation License,? (?:version |v\.? ?)1\.2
GFDL-1.3 | 75 | free documentation license | GNU Free Documentation License,? (?:version |v\.? ?)1\.3
GFDL-any | 45 | free documentation license | GNU Free Documentation License
GFDL-any | 35 | gfdl | \bGFDL\b
MPL-1.0 | 90 | mpl-1.0 | SPDX-License-Identifier: MPL-1\.0\b
MPL-1.1 | 90 | mpl-1.1 | SPDX-License-Identifier: MPL-1\.1\b
MPL-2.0 | 90 | mpl-2.0 | SPDX-License-Identifier: MPL-2\.0\b(?!-no)
MPL-2.0-no-copyleft | 92 | mpl-2.0-no | SPDX-License-Identifier: MPL-2\.0-no-copyleft-exception
MPL-2.0 | 80 | mozilla public | subject to the terms of the Mozilla Public License,? (?:version |v\.? ?)2\.0
MPL-1.1 | 80 | mozilla public | subject to the Mozilla Public License Version 1\.1
MPL-2.0 | 70 | mozilla public | Mozilla Public License,? (?:version |v\.? ?)?2\.0
MPL-1.1 | 70 | mozilla public | Mozilla Public License,? (?:version |v\.? ?)?1\.1
MPL-1.0 | 70 | mozilla public | Mozilla Public License,? (?:version |v\.? ?)?1\.0
MPL-2.0 | 65 | mozilla.org | mozilla\.org/(?:en-US/)?MPL/2\.0
MPL-any | 40 | mozilla public | Mozilla Public License
EPL-1.0 | 90 | epl-1.0 | SPDX-License-Identifier: EPL-1\.0\b
EPL-2.0 | 90 | epl-2.0 | SPDX-License-Identifier: EPL-2\.0\b
EPL-2.0 | 70 | eclipse public | Eclipse Public License,? (?:version |v\.? ?|- v ?)?2\.0
EPL-1.0 | 70 | eclipse public | Eclipse Public License,? (?:version |v\.? ?|- v ?)?1\.0
EPL-any | 40 | eclipse public | Eclipse Public License
EDL-1.0 | 60 | eclipse distribution | Eclipse Distribution License
CDDL-1.0 | 90 | cddl-1.0 | SPDX-License-Identifier: CDDL-1\.0\b
CDDL-1.1 | 90 | cddl-1.1 | SPDX-License-Identifier: CDDL-1\.1\b
CDDL-1.0 | 70 | common development and distribution | Common Development and Distribution License,? (?:\(CDDL\) )?(?:version |v\.? ?)?1\.0
CDDL-1.1 | 70 | common development and distribution | Common Development and Distribution License,? (?:\(CDDL\) )?(?:version |v\.? ?)?1\.1
CDDL-any | 40 | common development and distribution | Common Development and Distribution License
CPL-1.0 | 65 | common public license | Common Public License,? (?:version |v\.? ?|- v ?)?(?:1\.0)?
CPAL-1.0 | 65 | common public attribution | Common Public Attribution License
IPL-1.0 | 65 | ibm public | IBM Public License
APSL-2.0 | 70 | apple public source | Apple Public Source License,? (?:version |v\.? ?)?2\.0
APSL-any | 50 | apple public source | Apple Public Source License
EUPL-1.1 | 90 | eupl-1.1 | SPDX-License-Identifier: EUPL-1\.1\b
EUPL-1.2 | 90 | eupl-1.2 | SPDX-License-Identifier: EUPL-1\.2\b
EUPL-1.2 | 70 | european union public | European Union Public Licen[cs]e,? (?:\(EUPL\) )?(?:version |v\.? ?)?1\.2
EUPL-1.1 | 70 | european union public | European Union Public Licen[cs]e,? (?:\(EUPL\) )?(?:version |v\.? ?)?1\.1
EUPL-any | 40 | european union public | European Union Public Licen[cs]e
OSL-3.0 | 70 | open software license | Open Software License,? (?:version |v\.? ?)?3\.0
OSL-any | 40 | open software license | Open Software License
AFL-3.0 | 70 | academic free | Academic Free License,? (?:version |v\.? ?)?3\.0
AFL-2.1 | 70 | academic free | Academic Free License,? (?:version |v\.? ?)?2\.1
AFL-any | 40 | academic free | Academic Free License
Artistic-1.0 | 70 | artistic license | Artistic License,? (?:version |v\.? ?)?1\.0
Artistic-2.0 | 70 | artistic license | Artistic License,? (?:version |v\.? ?)?2\.0
Artistic-2.0 | 90 | artistic-2.0 | SPDX-License-Identifier: Artistic-2\.0\b
Artistic-any | 40 | artistic license | \bArtistic License\b
Perl | 60 | same terms as perl | under the same terms as Perl(?: itself)?
BSL-1.0 | 90 | bsl-1.0 | SPDX-License-Identifier: BSL-1\.0\b
BSL-1.0 | 70 | boost software | Boost Software License(?:,? (?:-? ?)?Version 1\.0)?
BSL-1.0 | 65 | boost.org | boost\.org/LICENSE_1_0\.txt
BUSL-1.1 | 90 | busl-1.1 | SPDX-License-Identifier: BUSL-1\.1\b
BUSL-1.1 | 70 | business source | Business Source License(?: 1\.1)?
SSPL-1.0 | 90 | sspl-1.0 | SPDX-License-Identifier: SSPL-1\.0\b
SSPL-1.0 | 70 | server side public | Server Side Public License
Elastic-2.0 | 90 | elastic-2.0 | SPDX-License-Identifier: Elastic-2\.0\b
Elastic-2.0 | 70 | elastic license | Elastic License(?: 2\.0)?
Commons-Clause | 70 | commons clause | \bCommons Clause\b(?: License Condition)?
PolyForm-Noncommercial | 70 | polyform | PolyForm Noncommercial License
PolyForm-Small-Business | 70 | polyform | PolyForm Small Business License
PolyForm-any | 40 | polyform | \bPolyForm\b
Unlicense | 90 | unlicense | SPDX-License-Identifier: Unlicense\b
Unlicense | 75 | released into the public domain | This is free and unencumbered software released into the public domain
Unlicense | 60 | unlicense | \b(?:The )?Unlicense\b
Unlicense | 60 | unlicense.org | \bunlicense\.org\b
WTFPL | 90 | wtfpl | SPDX-License-Identifier: WTFPL\b
WTFPL | 70 | wtfpl | \bWTFPL\b
WTFPL | 75 | do what the | Do What The F\W?\w+ You Want To Public License
Zlib | 90 | zlib | SPDX-License-Identifier: Zlib\b
Zlib | 60 | zlib | \bzlib(?:/libpng)? License\b
Zlib | 70 | altered source versions | Altered source versions must be plainly marked as such
libpng | 60 | libpng | \blibpng License\b
PostgreSQL | 60 | postgresql licen | \bPostgreSQL Licen[cs]e\b
PSF-2.0 | 70 | python software foundation | Python Software Foundation License(?: Version 2)?
PSF-2.0 | 60 | psf license | \bPSF License\b
PHP-3.01 | 70 | php license | PHP License,? (?:version )?3\.01
PHP-any | 45 | php license | \bPHP License\b
Ruby | 55 | ruby license | \bRuby License\b
Vim | 55 | vim license | \bVim License\b
OpenSSL | 60 | openssl license | \bOpenSSL License\b
OpenSSL | 70 | openssl toolkit | for use in the OpenSSL Toolkit
W3C | 60 | w3c | W3C(?:\(R\)|®)? Software (?:Notice and )?License
NCSA | 65 | ncsa | University of Illinois/NCSA Open Source License
NCSA | 55 | ncsa | \bNCSA (?:Open Source )?License\b
Unicode | 60 | unicode license | Unicode License(?: Agreement)?
ICU | 60 | icu license | \bICU License\b
Intel | 55 | intel open source | Intel Open Source License
QPL-1.0 | 60 | q public | \bQ Public License\b
Sleepycat | 60 | sleepycat | \bSleepycat License\b
SIL-OFL-1.0 | 70 | open font license | SIL Open Font License,? (?:version )?1\.0
SIL-OFL-1.1 | 70 | open font license | SIL Open Font License,? (?:version )?1\.1
OFL-1.1 | 90 | ofl-1.1 | SPDX-License-Identifier: OFL-1\.1\b
SIL-OFL-any | 45 | open font license | (?:SIL )?Open Font License
Beerware | 60 | beer-ware | \bBEER-WARE LICENSE\b
Beerware | 60 | beerware | \bBeerware(?: License)?\b
JSON | 75 | good, not evil | The Software shall be used for Good, not Evil
Ms-PL | 65 | microsoft public | Microsoft Public License
Ms-RL | 65 | microsoft reciprocal | Microsoft Reciprocal License
MulanPSL-2.0 | 70 | mulan | Mulan (?:Permissive Software License|PSL),? ?v?2
MulanPSL-1.0 | 70 | mulan | Mulan (?:Permissive Software License|PSL),? ?v?1
CeCILL-2.1 | 70 | cecill | \bCeCILL(?:,| license)? ?(?:version |v\.? ?)?2\.1
CeCILL-B | 70 | cecill | \bCeCILL-B\b
CeCILL-C | 70 | cecill | \bCeCILL-C\b
CeCILL-any | 40 | cecill | \bCeCILL\b
UPL-1.0 | 70 | universal permissive | Universal Permissive License(?:,? (?:version |v\.? ?)?1\.0)?
ECL-2.0 | 70 | educational community | Educational Community License(?:,? (?:version )?2\.0)?
NASA-1.3 | 70 | nasa open source | NASA Open Source Agreement
RPL-1.5 | 70 | reciprocal public | Reciprocal Public License(?: 1\.5)?
Watcom-1.0 | 60 | watcom | Sybase Open Watcom Public License
SunPublic | 60 | sun public | Sun Public License
Nokia | 55 | nokia open source | Nokia Open Source License
RealNetworks | 55 | realnetworks public | RealNetworks Public Source License
Blue-Oak-1.0.0 | 70 | blue oak | Blue Oak Model License(?: 1\.0\.0)?
Hippocratic-2.1 | 65 | hippocratic | Hippocratic License(?: ?2\.1)?
Parity-7.0.0 | 65 | parity public | Parity Public License(?: 7\.0\.0)?
CC0-1.0 | 90 | cc0-1.0 | SPDX-License-Identifier: CC0-1\.0\b
CC0-1.0 | 70 | cc0 | \bCC0(?:[- ]1\.0)?(?: Universal)?\b
CC0-1.0 | 65 | publicdomain/zero | creativecommons\.org/publicdomain/zero/1\.0
CC-PDM-1.0 | 65 | publicdomain/mark | creativecommons\.org/publicdomain/mark/1\.0
CC-BY-NC-ND-4.0 | 86 | cc by-nc-nd | \bCC BY-NC-ND 4\.0\b
CC-BY-NC-ND-3.0 | 86 | cc by-nc-nd | \bCC BY-NC-ND 3\.0\b
CC-BY-NC-ND-any | 60 | cc by-nc-nd | \bCC BY-NC-ND\b
CC-BY-NC-SA-4.0 | 86 | cc by-nc-sa | \bCC BY-NC-SA 4\.0\b
CC-BY-NC-SA-3.0 | 86 | cc by-nc-sa | \bCC BY-NC-SA 3\.0\b
CC-BY-NC-SA-2.5 | 86 | cc by-nc-sa | \bCC BY-NC-SA 2\.5\b
CC-BY-NC-SA-any | 60 | cc by-nc-sa | \bCC BY-NC-SA\b
CC-BY-NC-4.0 | 85 | cc by-nc | \bCC BY-NC 4\.0\b
CC-BY-NC-3.0 | 85 | cc by-nc | \bCC BY-NC 3\.0\b
CC-BY-NC-any | 55 | cc by-nc | \bCC BY-NC\b(?!-)
CC-BY-ND-4.0 | 85 | cc by-nd | \bCC BY-ND 4\.0\b
CC-BY-ND-3.0 | 85 | cc by-nd | \bCC BY-ND 3\.0\b
CC-BY-ND-any | 55 | cc by-nd | \bCC BY-ND\b
CC-BY-SA-4.0 | 85 | cc by-sa | \bCC BY-SA 4\.0\b
CC-BY-SA-3.0 | 85 | cc by-sa | \bCC BY-SA 3\.0\b
CC-BY-SA-2.0 | 85 | cc by-sa | \bCC BY-SA 2\.0\b
CC-BY-SA-any | 55 | cc by-sa | \bCC BY-SA\b
CC-BY-4.0 | 84 | cc by | \bCC BY 4\.0\b
CC-BY-3.0 | 84 | cc by | \bCC BY 3\.0\b
CC-BY-2.0 | 84 | cc by | \bCC BY 2\.0\b
CC-BY-any | 50 | cc by | \bCC BY\b(?!-)
CC-BY-4.0 | 90 | cc-by-4.0 | SPDX-License-Identifier: CC-BY-4\.0\b
CC-BY-SA-4.0 | 90 | cc-by-sa-4.0 | SPDX-License-Identifier: CC-BY-SA-4\.0\b
CC-BY-NC-4.0 | 90 | cc-by-nc-4.0 | SPDX-License-Identifier: CC-BY-NC-4\.0\b
CC-BY-NC-SA-4.0 | 90 | cc-by-nc-sa-4.0 | SPDX-License-Identifier: CC-BY-NC-SA-4\.0\b
CC-BY-NC-ND-4.0 | 90 | cc-by-nc-nd-4.0 | SPDX-License-Identifier: CC-BY-NC-ND-4\.0\b
CC-BY-4.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by/4\.0
CC-BY-3.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by/3\.0
CC-BY-2.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by/2\.0
CC-BY-SA-4.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by-sa/4\.0
CC-BY-SA-3.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by-sa/3\.0
CC-BY-NC-4.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by-nc/4\.0
CC-BY-NC-SA-4.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-ND-4.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/4\.0
CC-BY-ND-4.0 | 75 | creativecommons.org | creativecommons\.org/licenses/by-nd/4\.0
CC-BY-4.0 | 80 | creative commons | Creative Commons Attribution 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-3.0 | 80 | creative commons | Creative Commons Attribution 3\.0(?: Unported)?(?: License)?
CC-BY-SA-4.0 | 82 | creative commons | Creative Commons Attribution-Share ?Alike 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-SA-3.0 | 82 | creative commons | Creative Commons Attribution-Share ?Alike 3\.0(?: Unported)?(?: License)?
CC-BY-NC-4.0 | 82 | creative commons | Creative Commons Attribution-Non-?Commercial 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-NC-SA-4.0 | 83 | creative commons | Creative Commons Attribution-Non-?Commercial-Share ?Alike 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-NC-ND-4.0 | 83 | creative commons | Creative Commons Attribution-Non-?Commercial-No ?Deriv(?:ative)?s 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-ND-4.0 | 82 | creative commons | Creative Commons Attribution-No ?Deriv(?:ative)?s 4\.0(?: International)?(?: (?:Public )?License)?
CC-any | 30 | creative commons | Creative Commons(?: [\w-]+){0,3} License
ODbL-1.0 | 70 | database license | Open (?:Data Commons )?(?:Open )?Database License(?: v?1\.0)?
ODC-By-1.0 | 70 | open data commons attribution | Open Data Commons Attribution License(?: v?1\.0)?
PDDL-1.0 | 70 | public domain dedication | Public Domain Dedication and License
CDLA-Permissive | 70 | community data license | Community Data License Agreement[ -–]+Permissive
CDLA-Sharing | 70 | community data license | Community Data License Agreement[ -–]+Sharing
OGL-UK | 60 | open government licen | Open Government Licen[cs]e
OpenRAIL | 60 | rail | \b(?:Big(?:Science|Code) )?Open ?RAIL(?:-?[MS]{1,2})?\b
Llama-2 | 60 | llama 2 community | Llama 2 Community License
public-domain | 50 | public domain | (?:is|are|placed|released|dedicated) (?:hereby )?(?:in|into|to) the public domain
public-domain | 30 | public domain | \bpublic domain\b
proprietary | 50 | all rights reserved | All rights reserved
proprietary | 55 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 55 | unauthorized copying | Unauthorized copying of this file,? via any medium,? is strictly prohibited
proprietary | 50 | agreement | End[- ]User Licen[cs]e Agreement
proprietary | 45 | no part of this | No part of this (?:publication|work|book|document) may be reproduced
warranty | 20 | without warranty | (?:provided|distributed) .{0,40}without warranty of any kind
warranty | 20 | provided | provided ["'“]?as[- ]is["'”]?
warranty | 20 | without any warranty | WITHOUT ANY WARRANTY
copyright | 15 | copyright | Copyright (?:\(c\)|©)? ?\d{4}(?: ?[-–,] ?\d{4})*
copyright | 12 | copyright | Copyright (?:\(c\)|©)
reference | 25 | license | (?:see|refer to) (?:the )?(?:accompanying |included )?LICENSE(?:\.(?:txt|md))? file
reference | 25 | license.txt | (?:see|refer to) (?:the )?(?:file )?LICENSE\.txt
"""
