"""Licence notices the detector knows: (label, text). Phrases in brackets are mandatory, all of a notice's must stand in place.

A notice is cut where a name or a year is filled in, as whatever follows such a place stands at no fixed distance.
"""

from __future__ import annotations

#: Base phrases and labels of the contract.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Public licence notices and the short ways of naming a licence.
NOTICES = (
    ("mit", "[mit license]"),
    ("mit", """[Permission is hereby granted, free of charge], to any person obtaining a copy of this software and associated
        documentation files (the "Software"), [to deal in the Software without restriction], including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", """[Permission is hereby granted, free of charge], to any person obtaining a copy"""),
    ("apache-2", """[Licensed under the Apache License], Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("apache-2", """Unless required by applicable law or agreed to in writing, software [distributed under the License is
        distributed on an "AS IS" BASIS], WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the [specific language governing permissions and limitations under the License]."""),
    ("gpl", "[GNU General Public License]"),
    ("gpl-2", "[GNU General Public License version 2] or any later version"),
    ("gpl-3", "[GNU General Public License version 3] or any later version"),
    ("gpl-2", """you can [redistribute it and/or modify it under the terms of the GNU General Public License] as published by the
        Free Software Foundation; either [version 2 of the License], or (at your option) any later version."""),
    ("gpl-3", """you can [redistribute it and/or modify it under the terms of the GNU General Public License] as published by the
        Free Software Foundation, either [version 3 of the License], or (at your option) any later version."""),
    ("lgpl", "[GNU Lesser General Public License] version 3"),
    ("lgpl", """you can redistribute it and/or modify it [under the terms of the GNU Lesser General Public License] as published
        by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("agpl-3", "[GNU Affero General Public License] version 3"),
    ("agpl-3", """you can redistribute it and/or modify it [under the terms of the GNU Affero General Public License] as published
        by the Free Software Foundation, either [version 3 of the License], or (at your option) any later version."""),
    ("mpl-2", "[Mozilla Public License] version 2.0"),
    ("mpl-2", """This Source Code Form is [subject to the terms of the Mozilla Public License, v. 2.0]. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("bsd", "[BSD license]"),
    ("bsd", """[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    ("isc", "[ISC license]"),
    ("isc", """[Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted], provided that the above copyright notice and this permission notice appear in all copies."""),
    ("epl-2", "[Eclipse Public License] version 2.0"),
    ("epl-2", """This program and the accompanying materials are [made available under the terms of the Eclipse Public License] 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. [Permission is granted to anyone to use this software
        for any purpose], including commercial applications, and to [alter it and redistribute it freely], subject to the
        following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software."""),
    ("bsl-1", "Distributed under the [Boost Software License], Version 1.0."),
    ("cc-by", "[Creative Commons Attribution] 4.0 International"),
    ("cc-by-nc", "[Creative Commons Attribution-NonCommercial] 4.0 International License"),
    ("cc-by-nc", "This work is [licensed under CC BY-NC] 4.0"),
    ("cc-by-sa", "[Creative Commons Attribution-ShareAlike] 4.0 International License"),
    ("cc-by-sa", "[CC BY-SA] 4.0"),
    ("cc0", "[Creative Commons Zero] 1.0"),
    ("cc0", """To the extent possible under law, the author [has waived all copyright and related or neighboring rights] to this
        work."""),
    ("unlicense", """This is [free and unencumbered software released into the public domain]. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
)
