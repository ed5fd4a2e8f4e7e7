"""A few scripts and an old catalog of them."""

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "home.qsrc": "# home\nact 'Go ''out''': gt 'street', 'in'\n$x = 'Hello ' + $name + ', welcome!'\nif $args[0] = 'start':\n  msg 'You see <b>it</b> here.'\nend\n*pl 'One more line of text.'\n-\n",
    "street.qsrc": "# street\n'The street is long.'\nif a = 1: gs 'shop'\n'img/street.png'\nact 'Back home':\n  gt 'home'\nend\n-\n",
    "broken.qsrc": "# broken\nif a = 1:\n  'no end (here'\n-\n",
    "lint.qsrc": "# other\n!! qlint:ignore=ARGSCOUNT\ngosub\ngosub\njump 'a', 'b'\n \t'mixed indent'\n-\n",
}
TRANSLATED = {
    "home.qsrc": SOURCES["home.qsrc"].replace("'street'", "'road'").replace("'start'", "'begin'"),
    "street.qsrc": SOURCES["street.qsrc"].replace("The street is long.", "Die Straße ist lang."),
    "extra.qsrc": "# extra\n'new'\n-\n",
}


def texts(spark: SparkSession, of: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(of.items()), "path string, text string")


def old_catalog(spark: SparkSession) -> DataFrame:
    rows = [
        ("home.qsrc", 0, "home|act|Go_out", "Go ''out''", "Geh ''raus''", 1, "<<POS:00000013>>"),
        ("home.qsrc", 1, "home|var|Hello", "'Hello ' + $who + ', welcome!'", "'Hallo ' + $who + ', willkommen!'", 5, ""),
        ("home.qsrc", 2, "home|msg|You_see", "You see <b>it</b> there.", "Du siehst <b>es</b> dort.", 3, "<<POS:00000090>>"),
        ("home.qsrc", 3, "home|text|gone", "This was cut from the script.", "Das fiel weg.", 1, ""),
        ("gone.qsrc", 0, "gone|text|bye", "Good bye to the old file.", "Ade.", 1, ""),
    ]
    return spark.createDataFrame(rows, "path string, entry_idx int, key string, original string, translation string, stage int, context string")
