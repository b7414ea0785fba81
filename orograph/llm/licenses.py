"""Licence notices in documents: a trained paragraph classifier whose findings templates confirm.

A paragraph is a run of lines without a blank one between them; marks of comments around its lines are left out. Words and word pairs and triples are sparse
features of a softmax regression over licence families, other
notices (``unknown``) and plain text (``none``), trained on the wordings below and on variations and parts of them made by rule.
Every line of every document is classified; neighbouring lines of a paragraph that aren't plain text are one notice, whose words are classified as a whole, so a
notice that is wrapped over lines, or stands within a longer paragraph, is one finding.

``unknown`` is also trained on grants that are put together from their usual parts, and on sentences that put something under a licence with a made-up name.
Probabilities are calibrated by a temperature; a text is a notice if all notices together reach the limit ``notice``, and a family whose probability is under ``sure`` becomes
``unknown``. All three are fitted on models that leave out some families each, kin together: on variations which these have not seen, and on the notices of the families left out, which are unknown to them. A family is confirmed where the notice and one of the
family's templates share enough word triples.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import text_of

NONE, UNKNOWN = "none", "unknown"

#: Wordings of each family. Phrases of the public licences and of usual notices that name them.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "MIT License",
        "Distributed under the MIT licence, see LICENSE.txt for the full text.",
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for full license information.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This project is available under the terms of the MIT License.",
        "https://opensource.org/licenses/MIT",
    ],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Distributed under the Apache-2.0 licence.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This software is released under the Apache 2.0 license.",
    ],
    "BSD": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the 3-Clause BSD License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This code is released under the GNU GPL v2.",
        "https://www.gnu.org/licenses/gpl-3.0.html",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY-NC": [
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung - Nicht kommerziell 4.0 International Lizenz.",
        "Cette oeuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution - Pas d'Utilisation Commerciale 4.0 International.",
        "Esta obra está bajo una licencia de Creative Commons Reconocimiento-NoComercial 4.0 Internacional.",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC-SA 4.0.",
        "https://creativecommons.org/licenses/by-nc/4.0/",
        "http://creativecommons.org/licenses/by-nc-sa/3.0/",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.",
        "Cette oeuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution 4.0 International.",
        "Esta obra está bajo una licencia de Creative Commons Reconocimiento 4.0 Internacional.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
        "https://creativecommons.org/licenses/by/4.0/",
        "http://creativecommons.org/licenses/by-sa/3.0/",
    ],
    "Public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
        "This work has been dedicated to the public domain.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC license.",
    ],
    UNKNOWN: [
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
        "Alle Rechte vorbehalten. Nachdruck, auch auszugsweise, nur mit Genehmigung des Verlags.",
        "Toute reproduction sans autorisation de l'éditeur est interdite.",
        "Permission is granted to anyone to use this software for any purpose, subject to the following restrictions: the origin of this software must not be misrepresented.",
        "This package is licensed under the Artistic License 2.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "SPDX-License-Identifier: EPL-2.0",
        "SPDX-License-Identifier: LicenseRef-Proprietary",
        "This source code is the confidential property of its owner and may not be disclosed without written consent.",
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "Licensed under the terms of the agreement between the parties.",
        "You may use this material under the license that your vendor gave you.",
        "The license of this data set is described in the accompanying document.",
        "Released under a custom license, see the terms of use.",
        "No part of this publication may be reproduced without the permission of the publisher.",
        "Jede Vervielfältigung ohne Zustimmung des Herausgebers ist untersagt und darf nur auszugsweise erfolgen.",
        "Dieses Buch darf ohne Genehmigung weder kopiert noch gespeichert oder anders vervielfältigt werden.",
        "Queda prohibida la reproducción total o parcial de esta obra sin permiso del editor.",
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Eclipse Public License.",
    ],
    NONE: [
        "She had all the rights that the law of the land gave to her, and she used them.",
        "The driver lost his license after the accident and had to walk to work for a year.",
        "Apache is also the name of a people of the south west, and of a helicopter.",
        "He asked for permission to leave, which was granted, and went out of the room.",
        "The copyright office is on the third floor; the public may visit it on Mondays.",
        "A general is an officer in the army, and a public house is where he drinks.",
        "The software was slow, the warranty had run out and the source of the fault was never found.",
        "The common creative work of the class was shown to the parents under the roof of the school.",
        "Die Rechte und Pflichten der Bürger stehen im Gesetz, die Lizenz zum Fahren gibt das Amt.",
        "Les droits de l'homme sont le sujet de son livre, mis à la disposition de tous.",
        "Los derechos de las personas son iguales y la obra del autor fue muy leída.",
        "The version of the story that she told was free of any doubt and it was known to all the people of the village.",
        "You can see the list of names at the end of this work, and the following pages are about the use of tools.",
        "He received a letter from the public library and found a copy of the book that he had lost.",
        "It is not possible to say in which form the work was published or who the holder of the name was.",
        "General terms for the use of land are a matter of law in most places.",
        "The common people of the town made their own bread and sold it to any person who came along.",
        "If not for the rain we would have been there before this; see you at the fair.",
        "A file on the table was subject to change, and with or without a fee one could obtain it.",
        "Any part of the software that we use to copy text may be found with the source of this program.",
        "Der Fluss war in jenem Jahr so hoch wie nie zuvor und die Leute im Dorf gingen mit den Kindern zu Fuss.",
        "Mit dem Zug kam er in die Stadt, mit einem Brief und mit viel Zeit.",
        "La casa de la familia estaba cerca de la plaza y todos los dias venian los vecinos.",
        "Le chemin de la ville passe par les champs et les bois avant la riviere.",
    ],
}
#: Notices of families that neither training nor calibration sees, to measure on.
LEFT_OUT = [
    "Licensed under the European Union Public Licence, version 1.2.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "SPDX-License-Identifier: CDDL-1.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: OFL-1.1",
    "This program is published under the Microsoft Public License.",
    "SPDX-License-Identifier: EUPL-1.2",
    "Use of this software is governed by the Business Source License included in the file.",
    "Licensed under the Academic Free License version 3.0.",
    "This document is available under the GNU Free Documentation License.",
    "Released under the Server Side Public License, version 1.",
    "Available under the University of Illinois open source license.",
]
#: Short names of the families, and how notices use a name; training makes sentences of both, and of made-up names for ``unknown``.
NAMES = {
    "MIT": ["MIT", "the MIT License", "the Expat (MIT) licence"],
    "Apache-2.0": ["Apache 2.0", "the Apache License 2.0", "Apache-2.0"],
    "BSD": ["BSD", "the BSD 2-Clause License", "the three-clause BSD license", "BSD-3-Clause"],
    "GPL": ["the GPL", "GPLv3", "the GNU GPL version 2", "the GPL version 2 or later", "the GNU General Public License"],
    "LGPL": ["the LGPL", "LGPLv2.1", "the GNU LGPL version 3", "the GNU Lesser General Public License"],
    "AGPL": ["the AGPL", "AGPLv3", "the GNU AGPL version 3", "the GNU Affero General Public License"],
    "MPL-2.0": ["MPL 2.0", "the Mozilla Public License", "the MPL"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC-SA 4.0", "CC BY-NC-ND 3.0", "Creative Commons Attribution-NonCommercial"],
    "CC-BY": ["CC BY", "CC BY-SA 4.0", "CC BY 3.0", "Creative Commons Attribution", "der Creative Commons Lizenz Namensnennung"],
    "Public-domain": ["CC0", "the Unlicense", "the public domain dedication"],
    "ISC": ["the ISC License", "ISC"],
}
USES = [
    "Licensed under {}.", "Released under {}", "This project is licensed under {}.", "This document is available under {}", "Use of this software is governed by {}.",
    "Distributed under {}, see the file for details.", "The contents of this file are subject to the terms of {}.", "This program is published under {}", "License: {}",
    "You may use this under the terms of {}.", "This font is covered by {}.", "Dieser Text steht unter {}.", "{} licensed", "This crate is {} licensed.", "Available under {}.",
    "Ce programme est publié sous la licence {}.", "Ce texte est mis à disposition sous {}.", "Dieses Programm wird unter der Lizenz {} verbreitet.", "Veröffentlicht unter {}.",
    "L'application est diffusée sous licence {}.", "Sous licence {}", "Este programa se distribuye bajo la licencia {}.", "Esta biblioteca se publica bajo {}.", "Publicado bajo {}.", "{}", "You can redistribute it and/or modify it under {}.",
]
#: Parts of grants by sentence; each sentence takes one choice of each part. They are of no licence in particular.
GRANTS = [
    (
        "Anyone is free|Permission is granted|Permission is hereby given|Permission is hereby granted to anyone|You are free|Anyone is allowed|Everyone is permitted|You may|You are hereby granted the right|Licensee may|Users are permitted",
        "to use|to copy and share|to use, copy and distribute|to merge, embed and modify|to publish, compile or pass on|to do what they want with|to reproduce, display and execute|to redistribute|to alter and redistribute|to use, study, modify and embed|to sell copies of",
        "this software in any form|this software|the program|this font|the font software|the data|this document|the work|the library and its documentation|modified or unmodified copies|the code in source or object form|it freely",
        "for any purpose|without fee|free of charge|for commercial and private use|without a written agreement|subject to the following conditions:|as long as the name is changed|as you like"
        "|provided that this notice is kept|provided that credit is given|, including commercial applications,",
    ),
    (
        "The authors|In no event shall the university|In no event will the contributors|The copyright holders|Neither the company nor its suppliers|Under no circumstances shall the owner",
        "make no representations about the suitability of|be liable for any damages arising out of the use of|accept liability for loss caused by|disclaim all warranties with regard to",
        "this software|this program|these files|the materials|its documentation",
        "|, even if advised of the possibility of such damage|, whether in contract or tort|and have no obligation to provide support",
    ),
    (
        "This software|The program|This package|The material|The font|The database", "is provided as-is|comes with no warranty|is distributed without any guarantee|is offered on an as is basis",
        "without any express or implied warranty|to the extent permitted by law|and the user bears all risk|and without support",
    ),
    (
        "This notice|The copyright notices|A copy of these terms|This permission notice|The above statement|The names of the authors",
        "must be kept in|must not be removed from|shall appear in|has to be included with|may not be used to promote|may not be used for publicity or advertising of", "all copies|any source distribution|derived works|products derived from it|every redistribution",
    ),
    (
        "Altered versions|Modified files|Derivative works|Products that use it|Reserved names|Changes", "must be marked as such|must not be sold by themselves|may not use the original name|must be released under the same terms"
        "|must be plainly described|are not to be misrepresented as the original", "|unless permission is given by the author|in writing|and must stay under this license",
    ),
    (
        "It|This library|This module|The script|The collection", "is free software;|is freeware:|is shareware,|is open source and", "you can redistribute it and/or modify it|you may copy it as much as you like|use it",
        "under the same terms as the language itself|under the terms of its own license|but a donation is encouraged|at your own risk|for whatever you want",
    ),
    (
        "The package|This editor|The tool|This plugin|The software|The game", "is licensed, not sold.|is donationware:|is postcardware:|is charity supported.|is published as a gift.",
        "You can use and copy it|Do with it what you want|You bear all risk of using it|The contributors exclude all guarantees", "freely|but please make a donation|and buy the author a drink|and its conditions|for good causes only",
    ),
]
#: Plain sentences in the manner of grants, put together likewise.
PLAIN = [
    ("Permission was granted|You are free|Anyone is allowed|The guests were permitted|You may|He had the right|Users of the pool are asked|They were free",
     "to use|to copy|to share|to sell|to alter|to open|to leave|to study", "the kitchen|the boat|this room|the road|his letters|the old piano|the garden and its paths|apples|the picture",
     "for any purpose|without a fee|free of charge|for private use|as long as it is clean|as they liked|under the conditions of the day|provided that it was dry|before dinner"),
    ("The authors|The university|The company|The owner|The suppliers|The library and its staff|In no event would the crowd|Under no circumstances should a child",
     "made no claim about|be left alone with|accept the loss of|is offering a guarantee for|are known for|took no part in|published the results of|are closed during",
     "the study|the cause of the fire|the use of the bridge|these animals|the works of the artist|the repairs|the festival", "|without any conditions|in writing|to the public|last year|on Sundays"),
    ("This program|The software|The material|The font|The document|The book|The source of the river|A copy of the novel", "is on the radio|was slow|is hard to read|is made of wool|was found in a drawer|is sold at the fair|lies on the desk",
     "without any warning|and free for everyone|to the extent that it can|and the reader is lost|and without a name"),
    ("Changes in the law|Modified engines|The name of the author|The notice on the door|Original parts|Works of that kind|Versions of the tale", "must be described|must be tested|should appear|has to be read|may not be moved|are sold|were kept",
     "to the public|by the owner|in all copies of the book|before the race|without permission of the mayor|under the same roof|in the village"),
    ("It|The music|This ticket|The collection|The entry", "is free;|is cheap and|is open and", "you can use it|you may take it along|you can see it", "as you like|at your own risk|, said the man about the boat|every Monday|but bring a friend"),
]
#: Families that models leave out together for calibration: kin would be named for one another.
FOLDS = [("GPL", "LGPL", "AGPL"), ("CC-BY", "CC-BY-NC", "Public-domain"), ("MIT", "ISC", "BSD"), ("Apache-2.0", "MPL-2.0")]
#: SPDX identifiers by how they begin, longest first where one begins another.
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-": "BSD", "GPL-": "GPL", "LGPL-": "LGPL", "AGPL-": "AGPL", "MPL-2.0": "MPL-2.0",
    "CC-BY-NC-": "CC-BY-NC", "CC-BY-": "CC-BY", "CC0-": "Public-domain", "Unlicense": "Public-domain", "ISC": "ISC",
}
_WORD = re.compile(r"[^\W_](?:[^\W_]|[.+-](?=[^\W_]))*")
_COMMENT = re.compile(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|<!--|%+|\|)?[ \t]*|[ \t]*(?:\*+/|-->|\*+|\|)?[ \t\r]*$")
_SPDX = re.compile(r"SPDX-License-Identifier:\s*(.+)", re.IGNORECASE)
DIMENSIONS = 1 << 15
MEMO = 400_000
#: Largest share of plain sentences that may be taken for notices.
MISTAKEN = 0.002
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@cache
def _known() -> frozenset[str]:
    grants = [x for parts in GRANTS for part in parts for x in part.split("|")]
    return frozenset(w for texts in ([x for n, ts in TEMPLATES.items() if n != NONE for x in ts], grants) for t in texts for w in words_of(t))


class _Hashes:
    """The hash of a word, and whether a wording has it, remembered within a bounded table."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        found = list(map(self.memo.get, words))
        if None in found:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known, digest = _known(), xxhash.xxh64_intdigest
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.memo[words[i]] = digest(words[i].encode("utf-8", "replace")) & ~1 | (words[i] in known)
        return np.array(found, np.uint64)


_hashes = _Hashes()


def features(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all lines one after another, and where each line's begin: words, pairs, triples, and in how many eighths the wordings know the words."""
    sizes = np.array([len(x) for x in lines], np.int64)
    h = _hashes([w for x in lines for w in x])
    line = np.repeat(np.arange(len(lines)), sizes)
    parts, owners = [h], [line]
    mixed = h
    for n, odd in enumerate(_ODD, 1):
        mixed = mixed[:-1] * odd + h[n:] if len(h) > n else np.empty(0, np.uint64)
        inside = line[n:] == line[:-n] if len(h) > n else np.empty(0, bool)
        parts.append(mixed[inside])
        owners.append(line[n:][inside] if len(h) > n else np.empty(0, np.int64))
    at = np.concatenate(parts)
    at = ((at ^ (at >> np.uint64(29))) * _ODD[0] >> np.uint64(40)).astype(np.int64) % DIMENSIONS
    known = np.bincount(line, (h & np.uint64(1)).astype(float), len(lines)) * 8 // np.maximum(1, sizes)
    at = np.concatenate([at, DIMENSIONS + known.astype(np.int64)])
    owner = np.concatenate([*owners, np.arange(len(lines))])
    # Each feature once a line, by lines.
    both = np.unique(owner << 16 | at)
    return both & 0xFFFF, np.searchsorted(both >> 16, np.arange(len(lines)))


def _strange(words: list[str], rng: np.random.Generator) -> str:
    """A sentence of made-up words, words of plain text and up to three of a wording's, every third a short one: no notice."""
    size = int(rng.integers(0, 6)) if rng.random() < 0.4 else max(0, int(rng.integers(-10, 40)))
    made = ["".join(rng.choice(list("abdefghilmnorstuéäñ"), int(rng.integers(1, 12)))) for _ in range(size)]
    plain = [w for t in TEMPLATES[NONE] for w in words_of(t)]
    extra = [*rng.choice(plain, int(rng.integers(0, len(made) + 3))), *rng.choice(words, int(rng.integers(0 if made else 1, 4)))]
    for w in extra:
        made.insert(int(rng.integers(len(made) + 1)), str(w))
    return " ".join(made)


def _variations(text: str, n: int, rng: np.random.Generator) -> list[str]:
    """The wording with words left out, in parts as where lines are wrapped, in capitals, or with a name, year or other words around it."""
    words, out = text.split(), [text]
    around = ["Copyright (c) 2019 Example Contributors.", "Copyright 2021 A. Author", "See the file for details.", "Note:", "This module.", "Files here:"]
    for _ in range(n):
        w = list(words)
        if len(w) > 6:
            w = [x for x in w if rng.random() > 0.06]
        if len(w) > 12 and rng.random() < 0.6:
            size = int(rng.integers(8, max(9, len(w) * 2 // 3)))
            a = int(rng.integers(0, len(w) - size + 1))
            w = w[a : a + size]
        s = " ".join(w)
        kind = rng.random()
        if kind < 0.15:
            s = f"{around[int(rng.integers(len(around)))]} {s}"
        elif kind < 0.3:
            s = f"{s} {around[int(rng.integers(len(around)))]}"
        elif kind < 0.4:
            s = s.upper()
        out.append(s)
    return out


def _using(name: str | None, rng: np.random.Generator) -> str:
    """A sentence that puts something under a licence, of a made-up name where none is given."""
    if name is None:
        made = " ".join("".join(rng.choice(list("abdefghilmnorstu"), int(rng.integers(3, 10)))).capitalize() for _ in range(int(rng.integers(1, 4))))
        kind = rng.choice(["License", "Public License", "Licence", "Public Licence", "Open Source License", "Documentation License", "Source License", "agreement"])
        name = f"the {made} {kind}" + str(rng.choice(["", "", ", version 1", " version 2.0", " 1.1", " version 2"]))
    text = USES[int(rng.integers(len(USES)))].format(name)
    return text.upper() if rng.random() < 0.15 else text


def _normal(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _told(p: np.ndarray, none: int, limit: float) -> np.ndarray:
    """The class of each row: ``none`` where all notices together are less likely than ``limit``, else the likeliest notice."""
    rest = p.copy()
    rest[:, none] = -1
    return np.where(1 - p[:, none] < limit, none, rest.argmax(axis=1))


def _grant(rng: np.random.Generator, sentences: list[tuple[str, ...]] = GRANTS) -> str:
    """One to three sentences of a grant, at times without where they begin and end, as a wrapped line is."""
    said = []
    for k in rng.permutation(len(sentences))[: int(rng.integers(1, 4))]:
        said.append(" ".join(str(rng.choice(part.split("|"))) for part in sentences[k]).strip() + ".")
    words = " ".join(said).replace(" ,", ",").split()
    if len(words) > 9 and rng.random() < 0.6:
        size = int(rng.integers(6, min(16, len(words))))
        a = int(rng.integers(0, len(words) - size + 1))
        words = words[a : a + size]
    text = " ".join(words)
    return text.upper() if rng.random() < 0.2 else text


class Classifier:
    def __init__(self, seed: int = 11, epochs: int = 6, templates: dict[str, list[str]] = TEMPLATES):
        self.classes = sorted(templates)
        rng = np.random.default_rng(seed)
        rows, held = self._examples(templates, rng)
        unknown = self.classes.index(UNKNOWN)
        # Calibration: what models without some families say of variations that they have not seen, and of those families, which are unknown to them.
        said, marks, new = [], [], []
        for fold in FOLDS:
            out = [k for k, name in enumerate(self.classes) if name in fold]
            self.weights = self._train([r for r in rows if r[1] not in out], rng, epochs // 3)
            at, starts = features([words_of(t) for t, _ in held])
            said.append(self._scores(at, starts, np.diff(np.r_[starts, len(at)])))
            left = np.isin([k for _, k in held], out)
            marks.append(np.where(left, unknown, [k for _, k in held]))
            new.append(left)
        z, marks, new = np.concatenate(said), np.concatenate(marks), np.concatenate(new)
        loss = lambda t: -np.log(_normal(z / t)[np.arange(len(marks)), marks] + 1e-12).mean()
        self.temperature = min(np.geomspace(0.1, 10, 41).tolist(), key=loss)
        plain = _normal(z / self.temperature)[marks == self.classes.index(NONE), self.classes.index(NONE)]
        self.notice = next((t for t in np.arange(0.5, 0.96, 0.025).tolist() if (1 - plain >= t).mean() <= MISTAKEN), 0.95)
        p, best = _normal(z / self.temperature).max(axis=1), z.argmax(axis=1)
        named = ~np.isin(best, (unknown, self.classes.index(NONE)))
        right, wrong = named & (best == marks) & ~new, named & new
        # As many as can be are named rightly, less those of families left out that are misnamed, by their shares.
        gain = lambda s: (right & (p >= s)).sum() / max(1, right.sum()) - (wrong & (p >= s)).sum() / max(1, new.sum())
        self.sure = max(np.arange(0.1, 0.96, 0.025).tolist(), key=gain)
        self.weights = self._train(rows, rng, epochs)
        self.shingles = {
            name: [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in map(words_of, texts)]
            for name, texts in templates.items()
            if name not in (NONE, UNKNOWN)
        }

    def _examples(self, templates: dict[str, list[str]], rng: np.random.Generator) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """(text, class) to train on, and to calibrate with."""
        rows, held = [], []
        for k, name in enumerate(self.classes):
            for text in templates[name]:
                made = [(t, k) for t in _variations(text, 24, rng)]
                rows += made[:-5]
                held += made[-5:]
        for k, name in enumerate(self.classes):
            names = NAMES.get(name, [None] if name == UNKNOWN else [])
            made = [(_using(n, rng), k) for n in names for _ in range(32 if n else 700)]
            if name == UNKNOWN:
                made += [(_grant(rng), k) for _ in range(2600)]
            rows += made[::2] + made[1::4]
            held += made[3::4]
        every, none = sorted(_known()), self.classes.index(NONE)
        rows += [(_strange(every, rng), none) for _ in range(8000)] + [(_grant(rng, PLAIN), none) for _ in range(600)]
        held += [(_strange(every, rng), none) for _ in range(1000)] + [(_grant(rng, PLAIN), none) for _ in range(200)]
        return rows, held

    def _train(self, rows: list[tuple[str, int]], rng: np.random.Generator, epochs: int, batch: int = 64) -> np.ndarray:
        """Weights by adaptive gradient steps over batches; features are made once."""
        y = np.array([k for _, k in rows])
        every, begin = features([words_of(t) for t, _ in rows])
        size = np.diff(np.r_[begin, len(every)])
        self.weights = np.zeros((DIMENSIONS + 9, len(self.classes)))
        squares = np.full_like(self.weights, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), batch):
                own = order[i : i + batch]
                counts = size[own]
                starts = np.cumsum(counts) - counts
                at = every[np.repeat(begin[own] - starts, counts) + np.arange(counts.sum())]
                g = _normal(self._scores(at, starts, counts))
                g[np.arange(len(own)), y[own]] -= 1
                steps = np.repeat(g / np.sqrt(counts)[:, None], counts, axis=0)
                sort = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(at[sort]) > 0])
                total, own_rows = np.add.reduceat(steps[sort], first, axis=0), at[sort][first]
                squares[own_rows] += total * total
                self.weights[own_rows] -= 0.15 * total / np.sqrt(squares[own_rows])
        return self.weights

    def _scores(self, at: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[at], starts, axis=0) / np.sqrt(counts)[:, None]

    def probabilities(self, lines: list[list[str]], temperature: float | None = None) -> np.ndarray:
        if not lines:
            return np.empty((0, len(self.classes)))
        at, starts = features(lines)
        return _normal(self._scores(at, starts, np.diff(np.r_[starts, len(at)])) / (temperature or self.temperature))

    def classify(self, notice: str) -> tuple[str, float, float]:
        """(family, probability, template similarity); the similarity is to the family that was most likely, 0 for none."""
        words = words_of(notice)
        p = self.probabilities([words])[0]
        k = int(_told(p[None], self.classes.index(NONE), self.notice)[0])
        family, sure = self.classes[k], float(p[k])
        if family == NONE:
            return NONE, sure, 0.0
        own = frozenset(zip(words, words[1:], words[2:], strict=False))
        alike = max((len(own & t) / max(1, min(len(own), len(t))) for t in self.shingles.get(family, ())), default=0.0)
        return (family if sure >= self.sure else UNKNOWN), sure, alike

    def findings(self, texts: list[str]) -> list[list[tuple]]:
        """(first line, lines, family, probability, similarity, notice) of each notice of each text."""
        lines = [[_COMMENT.sub("", x) for x in t.split("\n")] for t in texts]
        words = [words_of(x) for own in lines for x in own]
        full = [i for i, w in enumerate(words) if w]
        none = self.classes.index(NONE)
        best, odds = np.full(len(words), none), np.zeros(len(words))
        for i in range(0, len(full), 4096):
            p = self.probabilities([words[j] for j in full[i : i + 4096]])
            told = _told(p, none, self.notice)
            best[full[i : i + 4096]] = told
            odds[full[i : i + 4096]] = p[np.arange(len(p)), told]
        out, at = [], 0
        for own in lines:
            found: list[tuple] = []
            hits = np.flatnonzero(best[at : at + len(own)] != none).tolist() if len(own) else []
            runs: list[list[int]] = []
            for i in hits:
                # One plain line within a notice is part of it; a blank line or another family ends it.
                if runs and i - (last := runs[-1][-1]) <= 2 and all(words[at + last + 1 : at + i]):
                    if min(odds[at + i], odds[at + last]) < self.sure or best[at + i] == best[at + last]:
                        runs[-1].append(i)
                        continue
                runs.append([i])
            for run in runs:
                notice = "\n".join(own[run[0] : run[-1] + 1])
                for part in _expression(notice):
                    family, sure, alike = self.classify(part)
                    if family != NONE:
                        found.append((run[0], run[-1] - run[0] + 1, family, sure, alike, notice))
            out.append(found)
            at += len(own)
        return out


def _expression(notice: str) -> list[str]:
    """The notice, or for an SPDX expression of several identifiers one for each of them."""
    m = _SPDX.search(notice)
    if not m:
        return [notice]
    names = re.split(r"[\s()]+(?:OR|AND|WITH)?[\s()]*", m[1].strip(" ()"))
    known = [n for n in names if any(n.startswith(k) for k in SPDX)]
    return [f"SPDX-License-Identifier: {n}" for n in known] if len(known) > 1 else [notice]


@cache
def classifier() -> Classifier:
    return Classifier()


_OUT = "paragraph int, lines int, family string, probability double, similarity double, confirmed boolean, notice string"


def scan(documents: DataFrame, confirm: float = 0.5) -> DataFrame:
    """Per notice found: doc_id, paragraph (number of its first line from 0), lines, family, probability, similarity, confirmed, notice (without comment marks).

    family is ``unknown`` for notices of no known family; an SPDX expression gives a row for each family in it. confirmed: the notice shares at least
    ``confirm`` of the word triples of the shorter of itself and a template of the family; a notice of fewer than three words has none.
    Of families that are equally likely the first by name counts. A notice of several paragraphs is a finding for each of them. Texts of any length are read whole. Null and empty texts have none. Rows may repeat
    and lack an id, and equal texts have equal findings; other columns are not looked at. An empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(classifier())  # DIMENSIONS rows of weights, whatever the input
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = shared.value.findings(part.column(1).to_pylist())
                rows = [(n, k, f, p, s, f != UNKNOWN and s >= confirm, text) for own in found for n, k, f, p, s, text in own]
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return documents.select("doc_id", text_of(documents).alias("text")).mapInArrow(run, f"doc_id {kind}, {_OUT}")
