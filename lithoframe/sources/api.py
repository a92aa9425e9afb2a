"""A Spark data source for paged JSON APIs.

``spark.read.format("json_api")`` with options ``url`` (with ``{page}``),
``pages`` and ``items`` (path of the list in an answer) gives one row of JSON
for each item; `pick_columns` turns them into columns by path specifications.
Each page is one partition.  Any URL scheme of urllib works, ``file:`` included.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lithoframe.functions.text import json_pick


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class JsonApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.pages = options["url"], int(options.get("pages", "1"))
        self.items, self.tries = options.get("items", ""), int(options.get("tries", "3"))

    def partitions(self):
        return [Page(n) for n in range(1, self.pages + 1)]

    def _fetch(self, url: str) -> bytes:
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=30) as answer:
                    return answer.read()
            except (urllib.error.URLError, TimeoutError):
                if k + 1 == self.tries:
                    raise
                time.sleep(2**k)
        return b""

    def read(self, partition: Page):
        data = json.loads(self._fetch(self.url.replace("{page}", str(partition.value))) or "[]")
        for step in self.items.split(".") if self.items else []:
            data = data.get(step) or [] if isinstance(data, dict) else []
        for item in data if isinstance(data, list) else [data]:
            yield (partition.value, json.dumps(item, ensure_ascii=False))


class JsonApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> JsonApiReader:
        return JsonApiReader(self.options)


def pick_columns(items: DataFrame, specs: dict[str, str]) -> DataFrame:
    """Columns by path specifications ``a.b|c[].d`` of the JSON column ``item``."""
    return items.select(*[json_pick(F.col("item"), s).alias(c) for c, s in specs.items()])


#: Column specifications of two public bibliographic services.
WORKS = {"title": "title|display_name", "doi": "doi|DOI", "year": "publication_year|issued.date-parts[][]", "journal": "primary_location.source.display_name|container-title[]", "url": "open_access.oa_url|URL"}
