"""Standard licence notices, wrapped as in source files, and the SQL on the given tables."""

import duckdb

from tessera.llm import licenses

MIT = """MIT License
Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""


def test_wrapped_notices_are_found(spark):
    texts = [MIT, APACHE, BSD, GPL, GPL.replace("version 3", "version 2"), "Released under the MIT\nLicense\nmore", "Not released under the MIT\nLicense"]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.permitted) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {
        0: ("2,3", "MIT", True), 1: ("4,5", "Apache-2.0", True), 2: ("11,12", "BSD", True), 3: ("15,8", "GPL-3.0", False), 4: ("14,8", "GPL", False), 5: ("1", "MIT", True), 6: ("", "", None),
    }


def test_given_documents_equal_the_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        want = con.execute(licenses.ORACLE).fetchall()
    assert sorted(map(str, map(tuple, licenses.scan_licenses(spark.read.parquet(path)).collect()))) == sorted(map(str, want))
