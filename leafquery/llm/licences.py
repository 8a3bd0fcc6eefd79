"""Licence scans by sentence rules. DataFrame functions only.

Texts are cut to sentences, normalised sentences are named by identifiers of known licence sentences, and the
sequence of identifiers is matched against ordered licence rules; what one rule has used, later ones don't see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafquery.llm.rules import bind

# Sentences of public licences and notices, normalised (letters and digits, single spaces).
SENTENCES = {
    "MIT grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation "
                  "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
                  "permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the software"],
    "MIT as is": ["the software is provided as is without warranty of any kind express or implied including but not limited to "
                  "the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MIT liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability "
                      "whether in an action of contract tort or otherwise arising from out of or in connection with the "
                      "software or the use or other dealings in the software"],
    "MIT name": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                 "mit license", "the mit license", "the mit license mit", "license mit", "spdx license identifier mit"],
    "BSD grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that "
                  "the following conditions are met"],
    "BSD source": ["redistributions of source code must retain the above copyright notice this list of conditions and the "
                   "following disclaimer"],
    "BSD binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                   "following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                  "products derived from this software without specific prior written permission"],
    "BSD name": ["bsd 2 clause license", "spdx license identifier bsd 2 clause", "released under the bsd license",
                 "licensed under the bsd license"],
    "BSD3 name": ["bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "Apache name": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license",
                    "apache license version 2.0", "released under the apache license version 2.0", "spdx license identifier apache 2.0"],
    "Apache use": ["you may not use this file except in compliance with the license"],
    "Apache copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "Apache as is": ["unless required by applicable law or agreed to in writing software distributed under the license is "
                     "distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "Apache see": ["see the license for the specific language governing permissions and limitations under the license"],
    "GPL3 name": ["this work is licensed under the gnu general public license version 3", "gnu general public license version 3",
                  "licensed under the gnu general public license version 3", "spdx license identifier gpl 3.0 only",
                  "released under the gnu general public license version 3"],
    "GPL3 later": ["spdx license identifier gpl 3.0 or later",
                   "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                   "public license as published by the free software foundation either version 3 of the license or at your "
                   "option any later version"],
    "GPL2 name": ["licensed under the gnu general public license version 2", "gnu general public license version 2",
                  "spdx license identifier gpl 2.0 only"],
    "GPL2 later": ["spdx license identifier gpl 2.0 or later",
                   "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                   "public license as published by the free software foundation either version 2 of the license or at your "
                   "option any later version"],
    "LGPL3 name": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0 only"],
    "AGPL3 name": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0 only"],
    "GPL warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the "
                     "implied warranty of merchantability or fitness for a particular purpose"],
    "MPL2 name": ["this source code form is subject to the terms of the mozilla public license v 2.0",
                  "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "CC0 name": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
                 "licensed under cc0 1.0", "spdx license identifier cc0 1.0"],
    "CC BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC BY-SA": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC BY-NC": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC BY-NC-ND": ["licensed under cc by nc nd 4.0"],
    "ISC grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                  "granted provided that the above copyright notice and this permission notice appear in all copies"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "Reserved": ["all rights reserved"],
}

# Licence rules in the order in which they are tried.
RULES = [
    ("MIT", ["MIT name", "Copyright", "MIT grant", "MIT notice", "MIT as is", "MIT liability"]),
    ("MIT", ["MIT grant", "MIT notice", "MIT as is", "MIT liability"]),
    ("MIT", ["MIT grant", "MIT notice", "MIT as is"]),
    ("BSD-3-Clause", ["BSD grant", "BSD source", "BSD binary", "BSD names"]),
    ("BSD-2-Clause", ["BSD grant", "BSD source", "BSD binary"]),
    ("Apache-2.0", ["Apache name", "Apache use", "Apache copy", "Apache as is", "Apache see"]),
    ("Apache-2.0", ["Apache use", "Apache copy", "Apache as is", "Apache see"]),
    ("GPL-3.0-or-later", ["GPL3 later", "GPL warranty"]),
    ("GPL-2.0-or-later", ["GPL2 later", "GPL warranty"]),
    ("GPL-3.0-or-later", ["GPL3 later"]),
    ("GPL-2.0-or-later", ["GPL2 later"]),
    ("GPL-3.0-only", ["GPL3 name"]),
    ("GPL-2.0-only", ["GPL2 name"]),
    ("LGPL-3.0-only", ["LGPL3 name"]),
    ("AGPL-3.0-only", ["AGPL3 name"]),
    ("MPL-2.0", ["MPL2 name"]),
    ("Apache-2.0", ["Apache name"]),
    ("MIT", ["MIT name"]),
    ("BSD-3-Clause", ["BSD3 name"]),
    ("BSD-2-Clause", ["BSD name"]),
    ("ISC", ["ISC grant"]),
    ("Unlicense", ["Unlicense"]),
    ("CC0-1.0", ["CC0 name"]),
    ("CC-BY-NC-ND-4.0", ["CC BY-NC-ND"]),
    ("CC-BY-NC-4.0", ["CC BY-NC"]),
    ("CC-BY-SA-4.0", ["CC BY-SA"]),
    ("CC-BY-4.0", ["CC BY"]),
    ("all-rights-reserved", ["Reserved"]),
]

#: A text without any of these words (in any case) holds no known sentence. Single words, since what stands between two is normalised later.
HINTS = "(?i)licen[sc]|permi|redistribut|warrant|copyright|unencumbered|waived|reserved|(?:\\(c\\)|©)"


def normalised(sentence: Column) -> Column:
    """Lower case; letters, digits and the dots inside numbers or names stay, all else is one space."""
    plain = F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")
    # a dot stays only between two characters of a name or version
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "\\.(?![a-z0-9])|(?<![a-z0-9])\\.", " "), " +", " "))


def identifier(sentence: Column) -> Column:
    """Identifier of a sentence, or null."""
    pairs = [(text, name) for name, texts in SENTENCES.items() for text in texts]
    texts, names = F.array(*[F.lit(t) for t, _ in pairs]), F.array(*[F.lit(n) for _, n in pairs])

    def of(s: Column) -> Column:
        place = F.array_position(texts, s)
        return F.when(place > 0, F.get(names, (place - 1).cast("int"))).when(
            s.rlike("^(?:copyright|c) (?:c )?[0-9]{4}\\b"), F.lit("Copyright"))
    return F.when(sentence.rlike(HINTS), bind(normalised(sentence), of))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence ends at a full stop, semicolon or question mark before white space, at a colon before a
    line end, or at a blank line. Where that is no known one, its lines are looked at, since notices often stand on a line without such a mark before;
    so are those of a copyright sentence, which may run on into others.
    """
    def of(sentence: Column) -> Column:
        def either(whole: Column) -> Column:
            lines = F.array_compact(F.transform(F.split(sentence, "\n", -1), identifier))
            return F.when(whole != "Copyright", F.array(whole)).otherwise(
                bind(lines, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(whole)))))
        return F.when(sentence.rlike(HINTS), bind(identifier(sentence), either))
    found = F.flatten(F.array_compact(F.transform(F.split(text, "(?<=[.;?])\\s+|(?<=:)\\s*\n\\s*|\n\\s*\n", -1), of)))
    return F.when(text.rlike(HINTS), found).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Licences of the rules that the identifier sequence meets, in the order of the rules."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(f"<{x}>" for x in seq) + "|").alias("seq"))
                      for name, seq in RULES])
    start = F.struct(F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "|"),
                              F.lit("|")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def try_(acc: Column, rule: Column) -> Column:
        hit = F.instr(acc["rest"], rule["seq"]) > 0
        # bars are doubled for the replacement, so that two occurrences side by side don't share one
        rest = F.replace(F.replace(F.replace(acc["rest"], F.lit("|"), F.lit("||")), F.concat(F.lit("|"), F.replace(
            rule["seq"], F.lit("|"), F.lit("||")), F.lit("|")), F.lit("||")), F.lit("||"), F.lit("|"))
        return F.when(hit, F.struct(rest.alias("rest"), F.array_append(acc["found"], rule["name"]).alias("found"))).otherwise(acc)

    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.aggregate(rules, start, try_, lambda acc: acc["found"])))


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(row, sentences, licences): known licence sentences of each whole text, in order, and its licences.

    Null, empty and plain texts have empty arrays. Each licence is given once, by the first rule that is
    met; a sentence that is known but completes no rule (a copyright line) is listed without a licence.
    Repeated rows are scanned alike; other columns come back in ``row``.
    """
    found = docs.select(F.struct("*").alias("row"), identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("sentences"))
    return found.select("row", "sentences", licences(F.col("sentences")).alias("licences"))
