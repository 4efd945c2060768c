"""Operator 9 [native], licence scans by sentence rules.

A text's sentences are normalised (lower case, runs of other characters than letters and digits as one blank) and mapped to
the identifiers of known licence sentences; a document's identifiers, in order, are matched against the rules in their order.
A rule is a sequence of identifiers that must occur in that order. Short notices ("Licensed under the ...") are built from
names of licences and forms of notices, one identifier for each licence. Sentences are taken both with lines joined and with line
ends as sentence ends, and what either reading recognises counts, in order of the text; where a joined sentence is known, its
lines are not looked at. All is row-local and built-in; there is no shuffle.

Cases: null and empty texts have no licence; a sentence that occurs again is recognised again; repeated rows are each
scanned; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of usual licence notices, by identifier.
SENTENCES = {
    1: "Released under the MIT License.",
    2: "Licensed under the MIT License.",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    5: "Licensed under the Apache License, Version 2.0.",
    6: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    7: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    8: "This work is licensed under the GNU General Public License, version 3.",
    9: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    10: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    11: "Licensed under CC BY-NC 4.0.",
    12: "Licensed under CC BY 4.0.",
    13: "Licensed under CC BY-SA 4.0.",
    14: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    15: "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    16: "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    17: "All rights reserved.",
    18: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    19: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    20: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    21: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    22: "This is free and unencumbered software released into the public domain.",
    23: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    24: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    25: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    26: "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    27: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    28: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    29: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    30: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    31: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    32: "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    33: "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    34: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    35: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    36: "Distributed under the Boost Software License, Version 1.0.",
    37: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    38: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    39: "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    40: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    41: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    42: "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    43: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    44: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    45: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    47: "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    48: "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    49: "This file is in the public domain.",
    50: "This work has been released into the public domain by its author.",
}
# The rules in order, each a licence and the identifiers that must follow one another.
RULES = [
    ("MIT", (3, 4)), ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3,)),
    ("Apache-2.0", (6, 7)), ("Apache-2.0", (5,)), ("Apache-2.0", (6,)),
    ("GPL-3.0", (9,)), ("GPL-3.0", (8,)), ("GPL-2.0", (10,)),
    ("BSD-3-Clause", (18, 19, 20, 21)), ("BSD-2-Clause", (18, 19, 20)),
    ("CC-BY-NC-4.0", (11,)), ("CC-BY-NC-4.0", (15,)), ("CC-BY-4.0", (12,)), ("CC-BY-4.0", (14,)), ("CC-BY-SA-4.0", (13,)), ("CC-BY-SA-4.0", (16,)),
    ("MPL-2.0", (23,)), ("ISC", (24,)), ("Unlicense", (22,)), ("All-rights-reserved", (17,)),
    ("LGPL-2.1", (25,)), ("LGPL-3.0", (26,)), ("LGPL-2.0", (27,)), ("AGPL-3.0", (28,)), ("GPL-2.0", (29,)), ("GPL-3.0", (30,)), ("GPL-2.0", (31,)),
    ("GFDL-1.2", (32,)), ("GFDL-1.3", (33,)), ("Zlib", (34,)), ("BSL-1.0", (35,)), ("BSL-1.0", (36,)), ("EPL-1.0", (37,)), ("EPL-2.0", (38,)), ("CDDL-1.0", (39,)),
    ("0BSD", (40,)), ("CC0-1.0", (41,)), ("OFL-1.1", (42,)), ("WTFPL", (43,)), ("MPL-1.1", (44,)), ("PostgreSQL", (45,)),
    ("GNU-license-text", (47,)), ("All-rights-reserved", (48,)), ("Public-domain", (49,)), ("Public-domain", (50,)),
]
#: Where a longer rule of the first licence matches, the second licence isn't reported for the same sentences.
COVERED = {"BSD-3-Clause": ("BSD-2-Clause",)}
# Names of licences in notices.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT license (MIT)", "Expat License"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License, version 2", "GNU GPL version 2 license", "GPL-2.0 License", "GPLv2 license"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3", "GNU GPL version 3 license", "GPL-3.0 License", "GPLv3 license"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPL-2.1 License"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPL-3.0 License"],
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPL-3.0 License", "AGPLv3 license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
    "0BSD": ["BSD Zero Clause License", "0BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License"],
    "MPL-1.1": ["Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0 License"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "European Union Public License 1.2"],
    "CDDL-1.0": ["Common Development and Distribution License", "CDDL-1.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python Software Foundation License"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    "WTFPL": ["WTFPL license", "Do What The Fuck You Want To Public License"],
    "OFL-1.1": ["SIL Open Font License", "SIL Open Font License 1.1"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License"],
    "GFDL-1.3": ["GNU Free Documentation License", "GNU Free Documentation License 1.3"],
    "CC0-1.0": ["Creative Commons Zero License", "CC0 1.0 Universal license", "CC0 1.0 license"],
} | {
    code.replace(" ", "-") + "-" + version: [f"{form.format(name=name, code='CC ' + code[3:], v=version)}" for form in ("Creative Commons {name} {v} International License", "Creative Commons {name} {v} License", "{code} {v} license", "{code} {v}", "CC-" + code[3:] + " {v}")]
    for code, name in (("CC BY", "Attribution"), ("CC BY-SA", "Attribution-ShareAlike"), ("CC BY-NC", "Attribution-NonCommercial"), ("CC BY-ND", "Attribution-NoDerivatives"), ("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    for version in ("3.0", "4.0")
}
# Forms of notices, of one beginning and one link each.
BEGINNINGS = ("Licensed", "Released", "Distributed", "This work is licensed", "This project is licensed", "This software is licensed")
LINKS = ("under", "under the", "under the terms of the")
#: Identifiers of notices, by licence.
NOTICES = {name: 1001 + k for k, name in enumerate(NAMES)}
RULES += [(name, (k,)) for name, k in NOTICES.items()]
#: Each known sentence has one of these words; a text without any has no known sentence.
TRIGGER = "licen[sc]e|rights reserved|permission|redistribut|public domain|copyright"
_STOP, _BLANKS = "[.!?:]", r"[\x20\x09-\x0D]+"
_END = f"({_STOP}){_BLANKS}"


def normal_pieces(sentence: str) -> list[str]:
    """The normalised sentences into which a known one falls by the rules for texts."""
    cut = re.sub(_END, "\\1\n", " ".join(sentence.split()))
    return [p for x in cut.split("\n") if (p := re.sub("[^a-z0-9]+", " ", x.lower()).strip())]


#: Normalised sentence to identifier; of a known sentence that falls into several, the longest stands for it.
KNOWN = {max(normal_pieces(s), key=len): k for k, s in SENTENCES.items()}
if len(KNOWN) != len(SENTENCES):
    raise AssertionError("known sentences must differ")
for _licence, _names in NAMES.items():
    for _notice in (f"{b} {link} {n}." for n in _names for b in BEGINNINGS for link in LINKS):
        if re.search(TRIGGER, _notice.lower()):  # others can't be seen
            KNOWN.setdefault(max(normal_pieces(_notice), key=len), NOTICES[_licence])
if not all(re.search(TRIGGER, s) for s in KNOWN):
    raise AssertionError("known sentences must have a trigger")


def _known() -> Column:
    """KNOWN as a constant: maps from sentence to identifier by the sentence's length, since maps are searched key by key."""
    by_length: dict[int, dict[str, int]] = {}
    for text, k in KNOWN.items():
        by_length.setdefault(len(text), {})[text] = k
    inner = lambda of: ", ".join(f"'{t}', {k}" for t, k in of.items())
    return F.expr("map(" + ", ".join(f"{n}, map({inner(of)})" for n, of in by_length.items()) + ")")


def _identified(sentence: Column, known: Column) -> Column:
    """The identifier of a sentence, or null."""
    normal = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    of_length = lambda n: F.try_element_at(F.try_element_at(known, F.length(n)), n)
    return F.when(normal.rlike(TRIGGER), of_length(normal))  # few sentences are worth the search


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    text, known = F.coalesce(text, F.lit("")), _known()
    # Line ends only cut joined sentences further, so a joined sentence that isn't known is read line by line in its place.
    joined = F.split(text, f"(?<={_STOP}){_BLANKS}")
    by_line = lambda s: F.array_compact(F.transform(F.split(s, "\n"), lambda line: _identified(line, known)))
    whole = F.transform(joined, lambda s: F.struct(s.alias("s"), _identified(s, known).alias("k")))
    found = F.flatten(F.transform(whole, lambda w: F.when(w["k"].isNotNull(), F.array(w["k"])).otherwise(by_line(w["s"]))))
    return F.when(F.lower(text).rlike(TRIGGER), found).otherwise(F.array().cast("array<int>"))


def matched(ids: Column) -> Column:
    """Licences of the rules that the identifiers meet, in order of the rules, each once."""
    line = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda k: F.concat(k.cast("string"), F.lit("|"))), "|"))
    hits = {name: None for name, _ in RULES}
    for name in hits:
        one = [line.like("%" + "%".join(f"|{k}|" for k in rule) + "%") for n, rule in RULES if n == name]
        test = one[0]
        for other in one[1:]:
            test = test | other
        hits[name] = test
    for name, less in COVERED.items():
        for n in less:
            hits[n] = hits[n] & ~hits[name]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in hits.items())))


def scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids, licenses of every row."""
    found = df.select(F.col(doc_id).alias("doc_id"), sentence_ids(F.col(text)).alias("sentence_ids"))
    return found.select("doc_id", "sentence_ids", matched(F.col("sentence_ids")).alias("licenses"))
