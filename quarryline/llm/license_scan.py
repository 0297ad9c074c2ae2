"""License scans by a positional index of rare words.

Templates (license phrases and notices) are indexed by word and position. A
word's IDF over the templates says how much it tells; each template is looked
up by its highest-IDF words. A file's words that the index knows vote for
(template, relative position); an alignment with enough votes is a candidate,
which is verified: its mandatory key phrases must stand where the template has
them, and its score is the share of the template's words in place.

The index is made from the templates alone, so its size does not depend on the
corpus; a row needs nothing but itself.

Defined cases: a null text counts as empty; an empty text has no words, no
labels and score 0; repeated rows each get their row; a null id stays null;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ._runtime import texts_of
from .words import letters_digits


@dataclass(frozen=True)
class Template:
    """label; words; phrases of which each must be in place; least share of words in place; base: counted as a phrase."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    least: float = 1.0
    base: bool = False


#: The base phrases, then notices, opening sentences and operative texts of well-known licenses
#: (whole ones under their SPDX names; of BSD-3-Clause what stands before the holder's name).
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge",),
        0.8,
    ),
    Template("mit-notice", "released under the mit license", ("the mit license",), 0.8),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",), 0.8),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",), 0.8),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",), 0.8),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",), 0.8),
    Template("agpl", "gnu affero general public license", ("affero general public license",), 0.8),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
        0.8,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("distribute this software for any purpose",),
        0.8,
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 0.8),
    Template("cc-by", "creative commons attribution", ("creative commons attribution",), 1.0),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",), 0.8),
    Template(
        "MIT",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
        software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and
        to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not
        limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
        any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software""",
        ("permission is hereby granted free of charge", "shall be included in all copies or substantial portions of the software"),
        0.8,
    ),
    Template(
        "MIT-0",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
        software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and
        to permit persons to whom the software is furnished to do so the software is provided as is without warranty of any kind express or implied including but not
        limited to the warranties of merchantability fitness for a particular purpose and noninfringement""",
        ("to permit persons to whom the software is furnished to do so the software is provided as is",),
        0.8,
    ),
    Template(
        "ISC",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and
        this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever
        resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
        ("provided that the above copyright notice and this permission notice appear in all copies",),
        0.8,
    ),
    Template(
        "0BSD",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author
        disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any
        special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or
        other tortious action arising out of or in connection with the use or performance of this software""",
        ("with or without fee is hereby granted the software is provided as is",),
        0.8,
    ),
    Template(
        "BSD-2-Clause",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of
        source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is
        provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability
        and fitness for a particular purpose are disclaimed""",
        ("provided with the distribution this software is provided by",),
        0.8,
    ),
    Template(
        "BSD-3-Clause",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of
        source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name
        of""",
        ("provided with the distribution 3 neither the name of",),
        0.8,
    ),
    Template(
        "Zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this
        software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to
        the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software
        in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and
        must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution""",
        ("altered source versions must be plainly marked as such",),
        0.8,
    ),
    Template(
        "Unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in
        source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large
        and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law""",
        ("dedicate any and all copyright interest in the software to the public domain",),
        0.8,
    ),
    Template(
        "BSL-1.0",
        """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to
        whom the software is furnished to do so all subject to the following""",
        ("any person or organization obtaining a copy of the software and accompanying documentation",),
        0.8,
    ),
    Template("WTFPL", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("as long as the name is changed",), 0.8),
    Template(
        "Apache-2.0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is
        basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under
        the license""",
        ("under the apache license version 2 0", "unless required by applicable law or agreed to in writing"),
        0.8,
    ),
    Template(
        "GPL-2.0-or-later",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        either version 2 of the license or at your option any later version""",
        ("the gnu general public license as published by", "either version 2 of the license"),
        0.8,
    ),
    Template(
        "GPL-3.0-or-later",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        either version 3 of the license or at your option any later version""",
        ("the gnu general public license as published by", "either version 3 of the license"),
        0.8,
    ),
    Template(
        "LGPL-2.1-or-later",
        """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software
        foundation either version 2 1 of the license or at your option any later version""",
        ("the gnu lesser general public license as published by", "either version 2 1 of the license"),
        0.8,
    ),
    Template(
        "AGPL-3.0-or-later",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software
        foundation either version 3 of the license or at your option any later version""",
        ("the gnu affero general public license as published by", "either version 3 of the license"),
        0.8,
    ),
    Template(
        "MPL-2.0",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at""",
        ("the mozilla public license v 2 0",),
        0.8,
    ),
    Template("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("the eclipse public license 2 0",), 0.8),
    Template("CC0-1.0", "waived all copyright and related or neighboring rights", ("related or neighboring rights",), 0.8),
    Template("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",), 0.8),
    Template("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",), 0.8),
    Template("spdx-mit", "spdx license identifier mit"),
    Template("spdx-apache", "spdx license identifier apache 2 0"),
    Template("spdx-gpl", "spdx license identifier gpl"),
)
#: Highest-IDF words by which a template is looked up, and the share of them that must vote.
ANCHORS = 5
VOTES = 0.6
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


class Index:
    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.words = [t.text.encode().split() for t in templates]
        df = Counter(w for words in self.words for w in set(words))
        self.idf = {w: math.log(len(templates) / n) for w, n in df.items()}
        #: word -> (template, position) where the template is looked up by it
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, words in enumerate(self.words):
            # Of equal words and equal IDFs the first; a short phrase is looked up by its rarest word.
            places = sorted({w: i for i, w in reversed([*enumerate(words)])}.items(), key=lambda x: (-self.idf[x[0]], x[1]))
            chosen = [i for _, i in places[: 1 if templates[t].base or templates[t].least == 1 else ANCHORS]]
            for i in chosen:
                self.postings[words[i]].append((t, i))
            self.needed.append(max(1, math.ceil(VOTES * len(chosen))) if len(chosen) > 1 else 1)
        self.keys = [[(self._place(words, k.encode().split()), k.encode().split()) for k in t.keys] for t, words in zip(templates, self.words, strict=True)]
        letter, lower = letters_digits()
        self.table = bytes(int(lower[b]) if letter[b] else 32 for b in range(256))

    @staticmethod
    def _place(words: list[bytes], key: list[bytes]) -> int:
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and (template, first word, share in place) of what is verified."""
        words = text.encode().translate(self.table).split()
        postings = self.postings
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for i, w in enumerate(words):
            if w in postings:
                for t, place in postings[w]:
                    votes[t, i - place] += 1
        found = []
        for (t, start), n in votes.items():
            own = self.words[t]
            if n < self.needed[t] or start < 0:
                continue
            if any(words[start + at : start + at + len(key)] != key for at, key in self.keys[t]):
                continue
            share = sum(a == b for a, b in zip(own, words[start : start + len(own)], strict=False)) / len(own)
            if share >= self.templates[t].least:
                found.append((t, start, share))
        return len(words), sorted(found)


_indexes: dict[tuple[Template, ...], Index] = {}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: places of the base phrases, labels, score and spans (label:first word:words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _indexes.setdefault(templates, None) or Index(templates)
        _indexes[templates] = index
        join = lambda labels: ",".join(sorted(set(labels)))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n, found = index.scan(text)
                base = [(t, s) for t, s, _ in found if templates[t].base]
                starts = [s for _, s in base] or [None]
                # A bare phrase tells less than a notice or a license text.
                score = max([0.0, *(share * (0.5 if templates[t].base else 1.0) for t, _, share in found)])
                spans = ",".join(f"{templates[t].label}:{s}:{len(index.words[t])}" for t, s, _ in sorted(found, key=lambda x: (x[1], x[0])))
                rows.append((n, len(base), min(starts), max(starts), join(templates[t].label for t, _ in base), join(templates[t].label for t, *_ in found), score, spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")]
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)
