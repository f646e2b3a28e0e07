import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tillsight.session import build_session  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="tillsight-tests", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="module", autouse=True)
def caches_end_with_module():
    """What a module caches goes with it: Spark puts a cached frame into every equal plan of the session."""
    yield
    session = SparkSession.getActiveSession()
    if session:
        session.catalog.clearCache()


DIRTY_CSV = """store_nbr,family,city,date,sales,transactions,onpromotion
1,GROCERY,Quito,01/05/2014,100.50,12,0
1,GROCERY,Quito,01/05/2014,100.50,12,0
1,DAIRY,Quito,1/5/2014,20,3,10
1,BREAD,Quito,01/05/2014,5,2,50
2,BREAD,Loja,02/05/2014,7,2,50.5
2,DAIRY,,02/05/2014,7,2,1
2,DAIRY,Loja,02/05/2014,0,4,1
2,DAIRY,Loja,02/05/2014,9,0,1
2,DAIRY,Loja,02/05/2014,-3,4,1
2,DAIRY,Loja,02/05/2014,abc,4,1
2,DAIRY,Loja,02/05/2014,NaN,5,1
2,DAIRY,Loja,31/31/2014,8,4,1
2,DAIRY,Loja,02/05/2014,8,4,x
2,EGGS,Loja,02/05/2014,8,12.7,1
3,CHEF'S CUT,Santa D'Or,03/05/2015,8,4,1
"""


@pytest.fixture(scope="session")
def dirty_csv_path(tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "sales.csv"
    p.write_text(DIRTY_CSV)
    return str(p)


@pytest.fixture(scope="session")
def dirty_raw(spark, dirty_csv_path):
    from tillsight.sources import read_sales_csv
    return read_sales_csv(spark, dirty_csv_path)


@pytest.fixture(scope="session")
def clean_sales(dirty_raw):
    from tillsight.operators.cleaning import clean
    return clean(dirty_raw).cache()
