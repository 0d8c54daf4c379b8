"""Templates of licence notices and the phrases that must stand in them. The wording
of the notices is their authors'."""

#: The base phrases and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label: (notice, phrases without which it isn't that licence)
TEMPLATES = {
    "mit": ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files, to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
            ["permission is hereby granted", "free of charge"]),
    "apache": ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0""", ["apache license", "version 2 0"]),
    "gpl": ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version""", ["gnu general public license"]),
    "lgpl": ("""This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation""", ["gnu lesser general public license"]),
    "bsd": ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""", ["redistribution and use in source and binary forms"]),
    "isc": ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies""",
            ["permission to use copy modify", "with or without fee"]),
    "mpl": ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/""", ["mozilla public license"]),
    "unlicense": ("""This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software""", ["released into the public domain"]),
    "cc-by": ("""This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy
        of this license, visit http://creativecommons.org/licenses/by/4.0/""", ["creative commons attribution"]),
    "cc-by-sa": ("""This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License.""",
                 ["creative commons attribution sharealike"]),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", ["cc by nc"]),
}
