"""A Ruby program made from the tables of a scale factor, a file for each row.

Every region is a module, every nation a class that mixes its region in, and
every supplier a class below its nation; a module for each nation holds it under other names.  What the engine should find in it
follows from the rows, so SQL over the same tables can say it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKOUT = "trade"

PLACE = """class Place
  def name
    nil
  end

  def describe
    name
  end

  def unused_here
    1
  end
end
"""

REGION = """module Region{r}
  def region_key
    {r}
  end

  def shared_{r}(a, b = 1)
    a
  end
end
"""

NATION = """class Nation{n} < Place
  include Region{r}

  LIMIT = {n}

  attr_reader :code

  def self.build(a)
    new
  end

  def describe
    region_key
    LIMIT
  end
end
"""

SUPPLIER = """class Supplier{s} < Nation{n}
  def ship(part)
    name
    place = Nation{m}.new
    place.describe
    rate(part)
  end

  def rate(part)
    LIMIT
  end

  def idle_{s}
    Region{r}
  end
end
"""

ALIAS = """module Alias{n}
  Home = Nation{n}
  Away = Home

  def self.make
    Away.build(1)
  end

  def self.guess(thing)
    thing.describe
  end
end
"""

#: A supplier ships to the nation with this key.
SHIPS_TO = "s_suppkey % 25"


def filled(template: str, **columns: str) -> Column:
    """The template with {x} replaced by the column of that name."""
    out = F.lit(template)
    for mark, column in columns.items():
        out = F.replace(out, F.lit("{" + mark + "}"), F.expr(f"cast({column} AS string)"))
    return out


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    region, nation, supplier = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("region", "nation", "supplier"))
    return region, nation, supplier.join(nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """checkout, path, content of the program's files."""
    region, nation, supplier = tables(spark, sf_dir)
    file = lambda df, path, text: df.select(F.lit(CHECKOUT).alias("checkout"), path.alias("path"), text.cast("binary").alias("content"))
    rows = [
        file(spark.range(1), F.lit("app/models/place.rb"), F.lit(PLACE)),
        file(region, filled("lib/regions/region{r}.rb", r="r_regionkey"), filled(REGION, r="r_regionkey")),
        file(nation, filled("app/models/nation{n}.rb", n="n_nationkey"), filled(NATION, n="n_nationkey", r="n_regionkey")),
        file(nation, filled("lib/aliases/alias{n}.rb", n="n_nationkey"), filled(ALIAS, n="n_nationkey")),
        file(supplier, filled("app/models/supplier{s}.rb", s="s_suppkey"), filled(SUPPLIER, s="s_suppkey", n="s_nationkey", m=SHIPS_TO, r="n_regionkey")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
