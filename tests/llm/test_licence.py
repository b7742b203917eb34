"""Licence notices as files hold them: hard-wrapped, in comments, among other text."""

import textwrap

import pytest
from force import shipped  # noqa: F401

from pacegrid.llm import licence

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
# without the third clause the conditions are those of BSD-2
WRAPPED = {"mit": MIT, "bsd-2-clause": BSD, "apache-2.0": APACHE, "gpl-3.0": GPL}
OTHER = "The river was high in the spring and the boats stayed in the harbour until the end of the month. " * 6


def scanned(spark, texts):
    rows = licence.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_notices(spark, width):
    """As a licence file, as a comment of a source file, and in the middle of a wrapped text."""
    forms = [
        lambda n: f"\n{textwrap.fill(n, width)}\n",
        lambda n: textwrap.fill(n, width, initial_indent=" * ", subsequent_indent=" * ") + "\n */\nint main;\n",
        lambda n: textwrap.fill(f"{OTHER}{n} {OTHER}", width),
    ]
    cases = [(family, form(notice)) for family, notice in WRAPPED.items() for form in forms]
    cases += [("", textwrap.fill(OTHER, width))]
    got = scanned(spark, [t for _, t in cases])
    assert [got[i]["families"] for i in range(len(cases))] == [f for f, _ in cases]
    assert all((got[i]["notices"] > 0) == bool(f) for i, (f, _) in enumerate(cases))


def test_notices_are_counted_once(spark):
    short = licence.TEMPLATES["mit"][0]
    texts = [f"{short}\n{OTHER}\n{short}", f"{short}\n{OTHER}\n{textwrap.fill(MIT, 60)}", f"{short}\n{short}"]
    got = scanned(spark, texts)
    assert [got[i]["notices"] for i in range(3)] == [2, 2, 2]


def test_several_notices_in_a_line_and_close_kin(spark):
    cases = {
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.": "apache-2.0,mit",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
        "Released under the BSD 2-Clause License.": "bsd-2-clause",
        "Released under the BSD 3-Clause License.": "bsd-3-clause",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0",
        "# SPDX-License-Identifier: (GPL-2.0-only OR MIT)": "gpl-2.0,mit",
        "Licensed under the Apache License, Version 1.1.": "",
        GPL.replace("version 3", "version 2"): "gpl-2.0",
    }
    got = scanned(spark, list(cases))
    assert [got[i]["families"] for i in range(len(cases))] == list(cases.values())


def test_every_template_is_its_family(spark):
    cases = [(f, n) for f, notices in licence.TEMPLATES.items() for n in notices]
    got = scanned(spark, [n for _, n in cases])
    assert [got[i]["families"] for i in range(len(cases))] == [f for f, _ in cases]


GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
WARRANTY = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.\n"
OWNER = "Copyright (c) 2020, The Authors\nAll rights reserved.\n\n"
ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
KEPT = ", provided that the above copyright notice and this permission notice appear in all copies"
AS_IS = ".\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.\n"
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/\n"
FILES = {
    "mit": f"MIT License\n\nCopyright (c) 2020 The Authors\n\n{MIT}\n",
    "bsd-2-clause": OWNER + GRANT + WARRANTY,
    "bsd-3-clause": OWNER + GRANT + THIRD + WARRANTY,
    "isc": "ISC License\n\n" + OWNER + ZERO + KEPT + AS_IS,
    "0bsd": OWNER + ZERO + AS_IS,
    "zlib": OWNER + ZLIB,
    "unlicense": UNLICENSE,
    "epl-2.0": EPL,
    "apache-2.0": OWNER + APACHE,
}


@pytest.mark.parametrize("width", [0, 72])
def test_whole_licence_files(spark, width):
    """Kin are told apart by what only one of them says; rights reserved in a copyright line are no licence."""
    wrapped = lambda text: "\n".join(textwrap.fill(line, width) if width else line for line in text.split("\n"))
    got = scanned(spark, [wrapped(text) for text in FILES.values()])
    assert [got[i]["families"] for i in range(len(FILES))] == list(FILES)


def test_headings_and_mentions(spark):
    cases = {
        "MIT License": "mit",
        "The MIT License (MIT)": "mit",
        "Licensed under the Apache License 2.0": "apache-2.0",
        "All rights reserved.": "proprietary",
        "Copyright 2020 The Authors. All rights reserved.": "proprietary",
        f"{OTHER}He read about an mit license to drive in the paper. {OTHER}": "",
        "Released under the BSD 2-Clause License.\nReleased under the BSD 3-Clause License.": "bsd-2-clause,bsd-3-clause",
    }
    got = scanned(spark, list(cases))
    assert [got[i]["families"] for i in range(len(cases))] == list(cases.values())
