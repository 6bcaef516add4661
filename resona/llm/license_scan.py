"""Licence detection by ordered signature rules, in DataFrame expressions only.

A text becomes its words (A-Z in lower case; ASCII letters and digits, and all
that is beyond ASCII). Every match of every rule holds one of the anchor words,
which are derived from the rules, and is no longer than ``span()`` words. Texts
are read in tiles of ``TILE`` words, with so many more to each side that
every match that begins in the tile, and all that contain it, are whole; tiles
in which no match can begin are dropped. A rule is a regex, woken by any of its gate
words in a tile and tried at every word if the tile holds all words that it needs. A detection is suppressed if
another one contains its interval with a better priority, or with the same
priority and more words, or, over the same words, an earlier rule. So the
detections are the same as over the whole text, and linear in it.

``SIGNATURES`` are rules written for one sentence, notice, address or expression
each; the others are licence families (a label and how it is named) in
forms (how a text says that it falls under a licence).

A null or empty text has no words and no labels, and scores 0. Repeated rows
are scanned one by one; other columns are not read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 64
#: The contract's phrases: a last word "license" after these words, and their labels.
BASE = ((("mit",), "mit"), (("apache",), "apache"), (("general", "public"), "gpl"))
#: Words, also with digits after them, of which every name and every signature holds one; the first is its anchor.
STEMS = ("license", "licence", "licenses", "licensed", "sublicense", "unlicense", "wtfpl", "gplv", "lgplv", "agplv", "redistributions", "advertising", "misrepresented", "contributors", "retain", "publicdomain", "zlib", "isc", "0bsd", "bsd", "apache", "gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "cc", "commons", "mit", "unencumbered", "redistribution", "granted", "permission", "domain", "reserved", "proprietary", "copyleft")
#: Words too common for a rule to wait for, if it has others.
_COMMON = frozenset("license licence version v public the software free open of in to a an is and or with this".split())

_V = "(?: (?:version|v))?"
_LIC = "(?: (?:public )?licen[sc]e)?"
#: (label, gate word, regex of the name, regex of the identifier).
FAMILIES: tuple[tuple[str, str, str, str], ...] = (
    ("mit", "mit", "mit(?: expat)?(?: licen[sc]e)?", "mit"),
    ("mit-0", "attribution", "mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("isc", "isc", "isc(?: licen[sc]e)?", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?(?: licen[sc]e)?", "zlib"),
    ("bsl-1.0", "boost", f"boost software licen[sc]e{_V}(?: 1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause|0 ?bsd)(?: licen[sc]e)?", "0bsd"),
    ("bsd-2-clause", "bsd", "(?:(?:2|two) clause bsd|simplified bsd|bsd (?:2|two) clause)(?: licen[sc]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:(?:3|three) clause bsd|new bsd|modified bsd|bsd (?:3|three) clause)(?: licen[sc]e)?", "bsd 3 clause"),
    ("bsd", "bsd", "bsd(?: style)?(?: licen[sc]e)?", "bsd"),
    *((f"apache-{v.replace(' ', '.')}", "apache", f"apache(?: software)?(?: licen[sc]e)?{_V} {v}(?: licen[sc]e)?", f"apache {v}") for v in ("1 0", "1 1", "2 0")),
    ("apache", "apache", "apache(?: software)? licen[sc]e", "apache"),
    *((f"gpl-{v}.0", "g", f"(?:gnu )?(?:general public licen[sc]e|gpl){_V} ?{v}(?: 0)?", f"gpl {v}(?: 0)?(?: only| or later)?") for v in (1, 2, 3)),
    ("gpl", "g", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: licen[sc]e)?", "gpl"),
    *((f"lgpl-{v.replace(' ', '.')}", "l", f"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl){_V} ?{v}(?: licen[sc]e)?", f"lgpl {v}(?: only| or later)?") for v in ("2 0", "2 1", "3 0")),
    ("lgpl", "l", "(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)(?: licen[sc]e)?", "lgpl"),
    ("agpl-3.0", "a", f"(?:gnu )?(?:affero general public licen[sc]e|agpl){_V} ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "a", "(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: licen[sc]e)?", "agpl"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation licen[sc]e{_V}(?: 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    *((f"mpl-{v.replace(' ', '.')}", "m", f"(?:mozilla public licen[sc]e|mpl){_V} {v}", f"mpl {v}") for v in ("1 0", "1 1", "2 0")),
    ("mpl", "m", "(?:mozilla public licen[sc]e|mpl licen[sc]e)", "mpl"),
    *((f"epl-{v.replace(' ', '.')}", "e", f"(?:eclipse public licen[sc]e|epl){_V} {v}", f"epl {v}") for v in ("1 0", "2 0")),
    ("cddl", "c", f"(?:common development and distribution licen[sc]e|cddl){_V}(?: 1 [01])?", "cddl 1 [01]"),
    ("eupl", "eu", f"(?:european union public licen[sc]e|eupl){_V}(?: 1 [012])?", "eupl 1 [012]"),
    ("artistic", "artistic", f"artistic licen[sc]e{_V}(?: [12] 0)?", "artistic [12] 0"),
    ("afl", "academic", f"academic free licen[sc]e{_V}(?: [123] \\d)?", "afl [123] \\d"),
    ("python", "python", f"(?:python software foundation|psf|python) licen[sc]e{_V}(?: 2(?: 0)?)?", "(?:psf|python) 2 0"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", "ms pl"),
    ("odbl-1.0", "database", f"open (?:data commons open )?database licen[sc]e{_V}(?: 1 0)?", "odbl 1 0"),
    ("ofl-1.1", "font", f"(?:sil )?open font licen[sc]e{_V}(?: 1 1)?", "ofl 1 1"),
    ("cc0-1.0", "cc", "(?:creative commons )?(?:cc ?0|cc zero)(?: 1 0)?(?: universal)?", "cc0 1 0"),
    *(
        (f"cc-{k.replace(' ', '-')}-{v.replace(' ', '.')}", "c", f"(?:cc {k}|creative commons {name}(?: international)?(?: licen[sc]e)?) {v}(?: international)?(?: licen[sc]e)?", f"cc {k} {v}")
        for v in ("2 0", "3 0", "4 0")
        for k, name in (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
    ),
    ("cc", "commons", "creative commons(?: (?:attribution|licen[sc]e)){0,2}", "cc"),
)
#: (priority, confidence, regex with {name} or {identifier}); the better, the smaller. A form is one of words around the name.
FORMS: tuple[tuple[int, float, str], ...] = (
    (1, 1.0, "spdx licen[sc]e identifier {identifier}"),
    (2, 0.95, "(?:dual )?(?:licen[sc]ed|released|distributed|published|provided|available|shared) (?:to you )?(?:under|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:an? |the |either the )?{name}"),
    (3, 0.9, "(?:under|subject to|in accordance with|by) the terms (?:and conditions )?of (?:an? |the ){name}"),
    (4, 0.85, "(?:governed|covered|protected) by (?:an? |the )?{name}"),
    (5, 0.7, "licen[sc]e(?: is| type| name)? (?:an? |the )?{name}"),
    (6, 0.6, "(?:the )?{name}"),
)
#: Rules written for one text each: (label, priority, confidence, regex). Sentences of licences, notices, addresses, expressions.
SIGNATURES: tuple[tuple[str, int, float, str], ...] = (
    # sentences of permissive licences
    ("mit", 2, 0.95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, 0.9, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 2, 0.85, "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", 2, 0.9, "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 2, 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, 0.85, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 2, 0.9, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", 2, 0.9, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, 0.8, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 3, 0.8, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 2, 0.9, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 2, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", 2, 0.9, "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", 3, 0.8, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", 2, 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ncsa", 2, 0.9, "university of illinois ncsa open source licen[sc]e"),
    ("x11", 3, 0.8, "x11 licen[sc]e"),
    ("x11", 3, 0.8, "mit x11 licen[sc]e"),
    ("curl", 3, 0.8, "curl licen[sc]e"),
    ("ntp", 2, 0.85, "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", 3, 0.8, "historical permission notice and disclaimer"),
    ("postgresql", 3, 0.8, "postgresql licen[sc]e"),
    ("postgresql", 2, 0.85, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("beerware", 2, 0.9, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", 3, 0.8, "beer ?ware licen[sc]e"),
    ("wtfpl", 2, 0.95, "do what the fuck you want to public licen[sc]e"),
    ("unlicense", 2, 0.95, "free and unencumbered software released into the public domain"),
    ("unlicense", 3, 0.85, "unlicense org"),
    ("cc0-1.0", 2, 0.9, "cc0 1 0 universal public domain dedication"),
    ("cc0-1.0", 3, 0.85, "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    # sentences of the Apache licence
    ("apache-2.0", 2, 0.95, "licensed under the apache licen[sc]e version 2 0"),
    ("apache-2.0", 2, 0.9, "you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at"),
    ("apache-2.0", 3, 0.8, "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2.0", 3, 0.8, "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-2.0", 3, 0.85, "terms and conditions for use reproduction and distribution 1 definitions licen[sc]e shall mean"),
    ("apache-2.0", 2, 0.9, "licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-1.1", 2, 0.85, "this product includes software developed by the apache software foundation"),
    # sentences of copyleft licences
    ("gpl", 3, 0.8, "redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2.0", 2, 0.9, "under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e"),
    ("gpl-3.0", 2, 0.9, "under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e"),
    ("gpl-2.0", 2, 0.9, "under the terms of the gnu general public licen[sc]e version 2 as published by the free software foundation"),
    ("gpl-3.0", 2, 0.9, "under the terms of the gnu general public licen[sc]e version 3 as published by the free software foundation"),
    ("gpl", 3, 0.8, "you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("gpl", 3, 0.75, "see the gnu general public licen[sc]e for more details"),
    ("lgpl", 3, 0.8, "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library"),
    ("lgpl", 3, 0.75, "see the gnu (?:lesser|library) general public licen[sc]e for more details"),
    ("lgpl-2.1", 2, 0.9, "under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e"),
    ("lgpl-3.0", 2, 0.9, "under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e"),
    ("agpl", 3, 0.8, "you should have received a copy of the gnu affero general public licen[sc]e along with this program"),
    ("agpl-3.0", 2, 0.9, "under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e"),
    ("gpl", 3, 0.75, "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
    ("gpl-classpath", 2, 0.9, "gpl (?:version )?2 (?:0 )?with (?:the )?classpath exception"),
    ("gfdl", 2, 0.85, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-2.0", 2, 0.95, "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-1.1", 2, 0.9, "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", 3, 0.85, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-1.0", 2, 0.9, "made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", 2, 0.9, "made available under the terms of the eclipse public licen[sc]e 2 0"),
    ("cddl", 2, 0.9, "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("eupl", 2, 0.9, "licensed under the eupl"),
    ("osl-3.0", 3, 0.85, "open software licen[sc]e(?: version| v)? 3 0"),
    ("cpl-1.0", 3, 0.85, "common public licen[sc]e(?: version| v)? 1 0"),
    ("ipl-1.0", 3, 0.85, "ibm public licen[sc]e(?: version| v)? 1 0"),
    ("qpl-1.0", 3, 0.8, "q public licen[sc]e"),
    ("cecill", 3, 0.8, "cecill(?: free software)? licen[sc]e"),
    ("sspl-1.0", 3, 0.85, "server side public licen[sc]e"),
    ("busl-1.1", 3, 0.85, "business source licen[sc]e(?: version)?(?: 1 1)?"),
    ("elastic-2.0", 3, 0.85, "elastic licen[sc]e(?: version)?(?: 2 0)?"),
    ("commons-clause", 3, 0.85, "commons clause licen[sc]e condition"),
    ("commons-clause", 4, 0.7, "commons clause"),
    # licences of media, data and fonts
    ("cc-by-4.0", 2, 0.9, "this work is licensed under a creative commons attribution 4 0 international licen[sc]e"),
    ("cc-by-sa-4.0", 2, 0.9, "this work is licensed under a creative commons attribution sharealike 4 0 international licen[sc]e"),
    ("cc-by-nc-4.0", 2, 0.9, "this work is licensed under a creative commons attribution noncommercial 4 0 international licen[sc]e"),
    ("cc-by-sa-3.0", 2, 0.9, "text is available under the creative commons attribution share ?alike licen[sc]e"),
    ("ofl-1.1", 2, 0.9, "this font software is licensed under the sil open font licen[sc]e version 1 1"),
    ("odc-by-1.0", 3, 0.85, "open data commons attribution licen[sc]e"),
    ("pddl-1.0", 3, 0.85, "open data commons public domain dedication and licen[sc]e"),
    ("odbl-1.0", 3, 0.85, "made available under the open database licen[sc]e"),
    ("cdla", 3, 0.85, "community data licen[sc]e agreement (?:permissive|sharing)"),
    ("ogl-uk", 3, 0.85, "open government licen[sc]e(?: v| version)?(?: [123] 0)?"),
    # addresses, as they stand without their signs
    ("mit", 3, 0.85, "opensource org licenses mit"),
    ("bsd-2-clause", 3, 0.85, "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", 3, 0.85, "opensource org licenses bsd 3 clause"),
    ("isc", 3, 0.85, "opensource org licenses isc"),
    ("apache-2.0", 3, 0.85, "opensource org licenses apache 2 0"),
    ("apache-2.0", 3, 0.9, "apache org licenses license 2 0"),
    ("apache-1.1", 3, 0.9, "apache org licenses license 1 1"),
    ("gpl-2.0", 3, 0.85, "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", 3, 0.85, "gnu org licenses gpl 3 0"),
    ("gpl", 4, 0.7, "gnu org licenses"),
    ("gpl", 3, 0.8, "gnu org licenses gpl"),
    ("gpl", 4, 0.7, "gnu org copyleft gpl"),
    ("lgpl-2.1", 3, 0.85, "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", 3, 0.85, "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", 3, 0.85, "gnu org licenses agpl 3 0"),
    ("gfdl", 3, 0.85, "gnu org licenses fdl(?: 1 [123])?"),
    ("mpl-2.0", 3, 0.9, "mozilla org mpl 2 0"),
    ("mpl-1.1", 3, 0.9, "mozilla org mpl mpl 1 1"),
    ("epl-1.0", 3, 0.9, "eclipse org legal epl v10"),
    ("epl-2.0", 3, 0.9, "eclipse org legal epl 2 0"),
    ("cc0-1.0", 3, 0.9, "creativecommons org publicdomain zero 1 0"),
    ("cc-by-2.0", 3, 0.9, "creativecommons org licenses by 2 0"),
    ("cc-by-3.0", 3, 0.9, "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", 3, 0.9, "creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", 3, 0.9, "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", 3, 0.9, "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", 3, 0.9, "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", 3, 0.9, "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", 3, 0.9, "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 3, 0.9, "creativecommons org licenses by nc nd 4 0"),
    ("bsl-1.0", 3, 0.85, "boost org license 1 0"),
    ("zlib", 3, 0.85, "zlib net zlib license"),
    # expressions of several licences
    ("apache-2.0 mit", 2, 0.9, "apache 2 0 (?:or|and) mit"),
    ("apache-2.0 mit", 2, 0.9, "mit (?:or|and) apache 2 0"),
    ("apache-2.0", 2, 0.85, "apache 2 0 with llvm exceptions?"),
    ("gpl-2.0", 2, 0.9, "gpl 2 0 (?:only|or later)"),
    ("gpl-3.0", 2, 0.9, "gpl 3 0 (?:only|or later)"),
    ("gpl-2.0", 3, 0.8, "gplv2(?: only)?"),
    ("gpl-3.0", 3, 0.8, "gplv3(?: only)?"),
    ("lgpl-2.1", 2, 0.9, "lgpl 2 1 (?:only|or later)"),
    ("lgpl-3.0", 2, 0.9, "lgpl 3 0 (?:only|or later)"),
    ("lgpl-3.0", 3, 0.8, "lgplv3"),
    ("agpl-3.0", 2, 0.9, "agpl 3 0 (?:only|or later)"),
    ("agpl-3.0", 3, 0.8, "agplv3"),
    ("epl-2.0", 2, 0.85, "epl 2 0 or gpl 2 0 with classpath exception"),
    ("bsd gpl", 3, 0.75, "(?:dual )?bsd (?:or|and) gpl"),
    ("gpl mit", 3, 0.75, "(?:dual )?mit (?:or|and) gpl"),
    # sentences of other licences, one each
    ("php-3.01", 2, 0.9, "redistribution and use in source and binary forms with or without modification is permitted provided that the following conditions are met"),
    ("php-3.01", 3, 0.85, "php licen[sc]e(?: version)? 3 01?"),
    ("ruby", 3, 0.85, "ruby licen[sc]e"),
    ("ruby", 3, 0.8, "you can redistribute it and or modify it under either the terms of the (?:gpl|gplv2)"),
    ("ruby", 4, 0.7, "same licen[sc]e as ruby"),
    ("w3c", 3, 0.85, "w3c software (?:notice and|and document notice and) licen[sc]e"),
    ("w3c", 2, 0.85, "permission to copy modify and distribute this (?:software|work) (?:and its documentation )?with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("json", 2, 0.9, "json licen[sc]e"),
    ("vim", 3, 0.85, "vim licen[sc]e"),
    ("vim", 3, 0.8, "there are no restrictions on distributing unmodified copies of vim except that they must include this licen[sc]e text"),
    ("artistic-1.0", 2, 0.9, "the artistic licen[sc]e preamble the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 2, 0.9, "this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-2.0", 3, 0.8, "artistic licen[sc]e 2 0"),
    ("openssl", 2, 0.9, "redistributions of any form whatsoever must retain the following acknowledge?ment this product includes software developed by the openssl project"),
    ("ssleay", 2, 0.9, "the licen[sc]e and distribution terms for any publically available version or derivative of this code cannot be changed"),
    ("python-2.0", 2, 0.9, "psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e to reproduce analyze test perform and or display publicly"),
    ("python-2.0", 3, 0.85, "this licen[sc]e agreement is between the python software foundation psf and the individual or organization licensee"),
    ("ms-pl", 2, 0.9, "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    ("ms-rl", 3, 0.85, "microsoft reciprocal licen[sc]e"),
    ("eupl-1.2", 2, 0.9, "this european union public licen[sc]e the eupl applies to the work"),
    ("cecill", 2, 0.85, "this software is governed by the cecill licen[sc]e under french law and abiding by the rules of distribution of free software"),
    ("cecill-b", 2, 0.87, "this software is governed by the cecill b licen[sc]e under french law"),
    ("cecill-c", 2, 0.87, "this software is governed by the cecill c licen[sc]e under french law"),
    ("afl-3.0", 2, 0.9, "licensed under the academic free licen[sc]e version 3 0"),
    ("osl-3.0", 2, 0.9, "licensed under the open software licen[sc]e version 3 0"),
    ("lppl-1.3c", 2, 0.9, "this work may be distributed and or modified under the conditions of the latex project public licen[sc]e"),
    ("lppl-1.3c", 3, 0.85, "latex project public licen[sc]e(?: version)?(?: 1 3c?)?"),
    ("zpl-2.1", 3, 0.85, "zope public licen[sc]e(?: zpl)?(?: version)?(?: 2 [01])?"),
    ("ijg", 2, 0.85, "permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee subject to these conditions"),
    ("libpng", 2, 0.85, "permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee subject to the following restrictions"),
    ("libpng", 3, 0.8, "libpng licen[sc]e"),
    ("freetype", 3, 0.85, "freetype (?:project )?licen[sc]e"),
    ("freetype", 2, 0.85, "this licen[sc]e applies to all files distributed in the original freetype project"),
    ("icu", 3, 0.85, "icu licen[sc]e"),
    ("unicode", 3, 0.85, "unicode (?:inc )?licen[sc]e agreement data files and software"),
    ("unicode", 2, 0.85, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("unicode", 3, 0.87, "unicode licen[sc]e v3"),
    ("tcl", 2, 0.85, "the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose"),
    ("sleepycat", 2, 0.85, "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("sleepycat", 3, 0.8, "sleepycat licen[sc]e"),
    ("info-zip", 3, 0.85, "info zip licen[sc]e"),
    ("info-zip", 2, 0.85, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the above disclaimer"),
    ("bzip2", 3, 0.85, "bzip2 licen[sc]e"),
    ("upl-1.0", 3, 0.87, "universal permissive licen[sc]e(?: upl)?(?: version| v)?(?: 1 0)?"),
    ("mulanpsl-2.0", 3, 0.87, "mulan permissive software licen[sc]e(?: version| v)?(?: ?2)?"),
    ("blueoak-1.0.0", 3, 0.87, "blue oak model licen[sc]e(?: version)?(?: 1 0 0)?"),
    ("fair", 3, 0.8, "fair licen[sc]e"),
    ("mit", 2, 0.96, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", 3, 0.8, "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit-cmu", 2, 0.85, "permission to use copy modify and distribute this software and its associated documentation for any purpose and without fee is hereby granted"),
    ("x11", 2, 0.85, "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("x11", 3, 0.8, "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("bsd-2-clause-freebsd", 3, 0.85, "freebsd licen[sc]e"),
    ("bsd-3-clause", 2, 0.88, "neither the name of the university nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 2, 0.88, "the names? of its contributors may not be used to endorse or promote products"),
    ("bsd-3-clause-clear", 3, 0.87, "no express or implied licenses to any party s patent rights are granted by this licen[sc]e"),
    ("bsd-4-clause-uc", 2, 0.92, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed by the university of california"),
    ("bsd", 3, 0.8, "this software is provided by the copyright holders and contributors as is"),
    ("bsd", 4, 0.75, "use of this source code is governed by a bsd style licen[sc]e"),
    ("bsd-source-code", 3, 0.85, "redistributions of source code must retain the copyright notice in the source code"),
    ("bsd-protection", 3, 0.85, "bsd protection licen[sc]e"),
    ("intel", 3, 0.85, "intel open source licen[sc]e"),
    ("naist-2003", 3, 0.8, "naist licen[sc]e"),
    ("ncsa", 2, 0.85, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("linux-openib", 3, 0.8, "openib org bsd licen[sc]e"),
    ("apache-2.0", 3, 0.8, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache-2.0", 3, 0.8, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable patent licen[sc]e"),
    ("apache-2.0", 3, 0.82, "the asf licenses this file to you under the apache licen[sc]e version 2 0"),
    ("apache-1.0", 3, 0.85, "redistributions of any form whatsoever must retain the following acknowledge?ment this product includes software developed by the apache group"),
    ("gpl", 3, 0.8, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 3, 0.82, "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("agpl-3.0", 3, 0.82, "the gnu affero general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("lgpl-3.0", 3, 0.82, "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e"),
    ("lgpl-2.1", 3, 0.82, "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public licen[sc]e version 2"),
    ("gpl-2.0", 2, 0.9, "under the terms of version 2 of the gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl-3.0", 2, 0.9, "under the terms of version 3 of the gnu general public licen[sc]e as published by the free software foundation"),
    ("lgpl-2.1", 2, 0.9, "under the terms of version 2 1 of the gnu lesser general public licen[sc]e as published by the free software foundation"),
    ("gpl-autoconf", 3, 0.85, "as a special exception to the gnu general public licen[sc]e if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-bison", 3, 0.85, "gpl with bison exception"),
    ("gpl-gcc", 3, 0.85, "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("gpl-linking", 3, 0.85, "thus the terms and conditions of the gnu general public licen[sc]e cover the whole combination"),
    ("gpl-syscall", 3, 0.85, "gpl 2 0 with linux syscall note"),
    ("mpl-2.0", 3, 0.85, "mozilla public licen[sc]e version 2 0 1 definitions"),
    ("mpl-2.0", 3, 0.8, "this source code form is incompatible with secondary licenses as defined by the mozilla public licen[sc]e"),
    ("mpl-1.0", 2, 0.9, "the contents of this file are subject to the mozilla public licen[sc]e version 1 0"),
    ("epl-2.0", 3, 0.85, "the accompanying program is provided under the terms of this eclipse public licen[sc]e agreement"),
    ("edl-1.0", 3, 0.85, "eclipse distribution licen[sc]e(?: version| v)?(?: 1 0)?"),
    ("cpl-1.0", 3, 0.85, "the accompanying program is provided under the terms of this common public licen[sc]e agreement"),
    ("cddl", 3, 0.85, "you can obtain a copy of the licen[sc]e at (?:usr src )?opensolaris licen[sc]e"),
    ("cddl-1.1", 3, 0.87, "cddl gpl 1 1"),
    ("apsl-2.0", 3, 0.87, "apple public source licen[sc]e(?: version)?(?: 2 0)?"),
    ("apsl-2.0", 2, 0.9, "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[sc]e"),
    ("npl-1.1", 3, 0.87, "netscape public licen[sc]e(?: version)?(?: 1 [01])?"),
    ("spl-1.0", 3, 0.87, "sun public licen[sc]e(?: version)?(?: 1 0)?"),
    ("nasa-1.3", 3, 0.87, "nasa open source agreement(?: version)?(?: 1 3)? licen[sc]e"),
    ("rpl-1.5", 3, 0.87, "reciprocal public licen[sc]e(?: version)?(?: 1 [15])?"),
    ("cpal-1.0", 3, 0.87, "common public attribution licen[sc]e(?: version)?(?: 1 0)?"),
    ("parity-7.0", 3, 0.87, "parity public licen[sc]e(?: version)?(?: [67] 0 0)?"),
    ("polyform-nc", 3, 0.87, "polyform noncommercial licen[sc]e(?: 1 0 0)?"),
    ("polyform-sb", 3, 0.87, "polyform small business licen[sc]e(?: 1 0 0)?"),
    ("prosperity-3.0", 3, 0.87, "prosperity public licen[sc]e(?: 3 0 0)?"),
    ("fsl-1.1", 3, 0.87, "functional source licen[sc]e(?: version)?(?: 1 1)?"),
    ("busl-1.1", 2, 0.9, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", 2, 0.9, "server side public licen[sc]e version 1"),
    ("elastic-2.0", 2, 0.9, "the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable licen[sc]e"),
    ("cc0-1.0", 3, 0.85, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-3.0", 2, 0.9, "this work is licensed under a creative commons attribution 3 0 unported licen[sc]e"),
    ("cc-by-sa-3.0", 2, 0.9, "this work is licensed under a creative commons attribution share ?alike 3 0 unported licen[sc]e"),
    ("cc-by-nc-nd-4.0", 2, 0.9, "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international licen[sc]e"),
    ("cc-by-nc-sa-4.0", 2, 0.9, "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international licen[sc]e"),
    ("cc-by-nd-4.0", 2, 0.9, "this work is licensed under a creative commons attribution noderivatives 4 0 international licen[sc]e"),
    ("ofl-1.1", 3, 0.85, "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ufl-1.0", 3, 0.87, "ubuntu font licen[sc]e(?: version)?(?: 1 0)?"),
    ("bitstream-vera", 3, 0.87, "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this licen[sc]e"),
    ("odc-by-1.0", 2, 0.9, "made available under the open data commons attribution licen[sc]e"),
    ("openrail", 3, 0.85, "(?:creativeml )?open ?rail(?: [ms])? licen[sc]e"),
    ("llama", 3, 0.85, "llama (?:2|3|3 1|3 2)? ?community licen[sc]e agreement"),
    ("gemma", 3, 0.8, "gemma terms of use licen[sc]e"),
    ("free-art-1.3", 3, 0.85, "free art licen[sc]e(?: 1 3)?"),
    ("dsl", 3, 0.8, "design science licen[sc]e"),
    ("opl-1.0", 3, 0.85, "open publication licen[sc]e(?: version| v)?(?: 1 0)?"),
    ("fdl-wiki", 3, 0.8, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e version 1 [123] or any later version"),
    # short names of versions
    ("lgpl-2.1", 3, 0.8, "lgplv2 1(?: only)?"),
    ("lgpl-2.0", 3, 0.8, "lgplv2(?: 0)?(?: only)?"),
    ("gpl-2.0", 3, 0.8, "gplv2 0"),
    ("agpl-1.0", 3, 0.8, "agplv1"),
    ("gpl-1.0", 3, 0.8, "gplv1"),
    ("apache-2.0", 3, 0.8, "apache v2"),
    # what belongs to all, and what does not
    ("public-domain", 3, 0.9, "(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", 4, 0.8, "(?:this|the) (?:work|code|file|software) is in the public domain"),
    ("public-domain", 6, 0.5, "(?:in )?the public domain"),
    ("proprietary", 5, 0.5, "all rights reserved"),
    ("proprietary", 4, 0.7, "proprietary (?:and confidential|licen[sc]e|software)"),
    ("proprietary", 3, 0.75, "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
    ("proprietary", 4, 0.7, "end user licen[sc]e agreement"),
    ("proprietary", 4, 0.65, "commercial licen[sc]e"),
    ("proprietary", 4, 0.65, "(?:this|the) software is licensed not sold"),
    ("unknown", 5, 0.4, "see (?:the )?licen[sc]e(?: file)? for (?:details|more information)"),
    ("unknown", 5, 0.4, "licensed under the same terms as"),
    ("copyleft", 6, 0.4, "copyleft"),
)


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, gate, priority, confidence, regex) of all rules, in order."""
    named = [(label, gate, p, c, form.format(name=f"(?:{name})", identifier=f"(?:{identifier})")) for p, c, form in FORMS for label, gate, name, identifier in FAMILIES]
    # a bare name is no licence unless the name itself says so
    named = [r for r in named if r[2] < 6 or r[0] not in ("mit", "isc", "zlib", "bsd")]
    bare = [(label, gate, 6, 0.6, f"(?:the )?{gate}(?: expat| style| libpng)? licen[sc]e") for label, gate in (("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("bsd", "bsd"))]
    return sorted([*((label, "", p, c, regex) for label, p, c, regex in SIGNATURES), *named, *bare], key=lambda r: r[2])


def _strings(nodes: list) -> Iterator[str]:
    """What a parsed regex matches; rules repeat nothing more than twice."""
    if not nodes:
        yield ""
        return
    op, arg = nodes[0]
    if op is sre.LITERAL:
        heads = [chr(arg)]
    elif op is sre.IN:
        heads = [c for kind, x in arg for c in ([chr(x)] if kind is sre.LITERAL else map(chr, range(x[0], x[1] + 1)) if kind is sre.RANGE else "0123456789")]
    elif op is sre.SUBPATTERN:
        heads = list(_strings(list(arg[3])))
    elif op is sre.BRANCH:
        heads = [x for branch in arg[1] for x in _strings(list(branch))]
    elif op is sre.MAX_REPEAT:
        if arg[0] or arg[1] > 2:
            raise ValueError("rules repeat a part from no to two times")
        one, heads = list(_strings(list(arg[2]))), [""]
        for _ in range(arg[1]):
            heads = list(dict.fromkeys([*heads, *(h + x for h in heads for x in one)]))
    else:
        raise ValueError(f"rules do not use {op}")
    for tail in _strings(nodes[1:]):
        for head in heads:
            yield head + tail


@cache
def strings(regex: str) -> tuple[str, ...]:
    """What a rule's regex, or a part of it, matches."""
    return tuple(dict.fromkeys(_strings(list(re._parser.parse(regex)))))


def _anchor(said: str) -> str:
    words = said.split()
    return next(w for stem in STEMS for w in words if w == stem or w.rstrip("0123456789") == stem)


def _needs(said: tuple[str, ...]) -> list[str]:
    """Few words of which each of what is said holds one."""
    left = [{w for w in x.split() if w not in _COMMON and len(w) > 1} or set(x.split()) for x in said]
    out = []
    while left:
        out.append(max(sorted({w for x in left for w in x}), key=lambda w: (sum(w in x for x in left), len(w))))
        left = [x for x in left if out[-1] not in x]
    return out


@cache
def _frame(form: str) -> tuple[tuple[str, ...], int]:
    """A form's words that its rules need, none for a bare name, and how many it may have around the name."""
    said = strings(form.replace("{name}", "").replace("{identifier}", ""))
    return tuple(_needs(said)) if all(x.strip() for x in said) else (), max(len(x.split()) for x in said)


@cache
def planned() -> tuple[tuple[list[list[str]], ...], tuple[str, ...], int]:
    """For each of rules() the groups of words of each of which it needs one; all anchors; the words of the longest match."""
    parts = {}
    for p, c, form in FORMS:
        for _label, _gate, name, identifier in FAMILIES:
            core = identifier if "{identifier}" in form else name
            parts[form.format(name=f"(?:{name})", identifier=f"(?:{identifier})")] = (form, core)
    needs, anchors, longest = [], set(), 0
    for _label, _gate, _p, _c, regex in rules():
        form, core = parts.get(regex, ("{name}", regex))
        words, around = _frame(form)
        said = strings(core)
        needs.append([g for g in (_needs(said), list(words)) if g])
        # an identifier only follows "license identifier"
        anchors |= {"license", "licence"} if "{identifier}" in form else {_anchor(x) for x in said}
        longest = max(longest, around + max(len(x.split()) for x in said))
    return tuple(needs), tuple(sorted(anchors)), longest


def span() -> int:
    return planned()[2]


def _rules() -> Column:
    needs = planned()[0]
    return F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.array(*[F.array(*[F.lit(f" {w} ") for w in g]) for g in needs[k]]).alias("needs"), F.lit(p).alias("priority"), F.lit(float(c)).alias("confidence"), F.lit(f"(?<= )(?=({regex}) )").alias("regex"))
        for k, (label, _gate, p, c, regex) in enumerate(rules())
    ])


@cache
def gated() -> dict[str, list[int]]:
    """By gate word the rules that may match where it stands: each rule waits for the words of its smallest group, of which it needs one."""
    out: dict[str, list[int]] = {}
    for k, groups in enumerate(planned()[0]):
        for w in min(groups, key=lambda g: (len(g), -min(map(len, g)))):
            out.setdefault(w, []).append(k)
    return dict(sorted(out.items()))


def normalised(text: Column) -> Column:
    """The words of a text, each after a single space, or an empty string."""
    upper = "".join(map(chr, range(65, 91)))
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, " ", ""))


def _detect(tile: Column) -> Column:
    """The kept detections that begin in a tile's own words: label, confidence."""
    text = tile["text"]

    def found(rule: Column) -> Column:
        said, between = F.regexp_extract_all(text, rule["regex"], F.lit(1)), F.split(text, rule["regex"], -1)

        def one(match: Column, j: Column) -> Column:
            start = _spaces(F.array_join(F.slice(between, F.lit(1), j + 1), ""))
            return F.struct(rule["k"].alias("k"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), start.alias("start"), (start + _spaces(match)).alias("end"))

        return F.transform(said, one)

    fits = lambda r: F.forall(r["needs"], lambda g: F.exists(g, lambda w: F.contains(text, w)))
    gates, waiting = F.array(*map(F.lit, gated())), F.array(*[F.array(*map(F.lit, ks)) for ks in gated().values()])
    woken = F.flatten(F.transform(F.array_intersect(gates, tile["words"]), lambda w: F.get(waiting, (F.array_position(gates, w) - 1).cast("int"))))
    hits = F.flatten(F.transform(F.filter(F.transform(F.array_distinct(woken), lambda k: F.get(_rules(), k)), fits), found))

    def beats(y: Column, x: Column) -> Column:
        holds = (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["k"] != x["k"])
        longer = (y["end"] - y["start"]) > (x["end"] - x["start"])
        same = (y["end"] - y["start"]) == (x["end"] - x["start"])
        return holds & ((y["priority"] < x["priority"]) | (y["priority"] == x["priority"]) & (longer | same & (y["k"] < x["k"])))

    own = lambda x: (x["start"] > tile["before"]) & (x["start"] <= tile["before"] + TILE)
    kept = lambda hits: F.filter(hits, lambda x: own(x) & ~F.exists(hits, lambda y: beats(y, x)))
    # hits are bound to a variable, so that they are not found again for each of them
    return F.transform(F.flatten(F.transform(F.array(hits), kept)), lambda d: F.struct(d["label"].alias("label"), d["confidence"].alias("confidence")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    norm = docs.select(F.col(key), normalised(F.col(text)).alias("norm"))
    n_words = F.when(F.col("norm") == "", 0).otherwise(_spaces(F.col("norm")) + 1).cast("long")
    split = norm.select(key, n_words.alias("n_words"), F.split("norm", " ").alias("words"))
    anchors = F.array(*map(F.lit, planned()[1]))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    placed = split.select(key, "n_words", "words", F.coalesce(F.when(F.arrays_overlap("words", anchors), places), F.array().cast("array<int>")).alias("places"))
    word = lambda i: F.get("words", i)

    def base(i: Column) -> Column:
        out = F.lit(None).cast("struct<start:bigint,label:string>")
        for before, label in BASE:
            fits = word(i) == "license"
            for k, w in enumerate(before):
                fits = fits & F.coalesce(word(i - len(before) + k) == w, F.lit(False))
            out = F.when(fits, F.struct((i - len(before)).cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    most = span()
    tiles = F.array_distinct(F.flatten(F.transform("places", lambda i: F.sequence(F.floor(F.greatest(i - most, F.lit(0)) / TILE), F.floor(i / TILE)))))

    def tile(t: Column) -> Column:
        first = F.greatest(t * TILE - most, F.lit(0))
        words = F.slice("words", (first + 1).cast("int"), ((t + 1) * TILE + most - first).cast("int"))
        return F.struct((t * TILE - first).cast("int").alias("before"), words.alias("words"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("text"))

    windows = placed.select(key, "n_words", F.filter(F.transform("places", base), lambda b: b.isNotNull()).alias("base"), F.array_distinct(F.transform(tiles, tile)).alias("windows"))
    found = windows.select(key, "n_words", "base", F.array_distinct(F.flatten(F.transform("windows", _detect))).alias("found"))
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    base_labels = F.col("base.label")
    labels = F.flatten(F.transform("found.label", lambda x: F.split(x, " ")))  # an expression of several licences has a label for each
    return found.select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, labels)).alias("labels"),
        F.greatest(F.coalesce(F.array_max("found.confidence"), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
    )
