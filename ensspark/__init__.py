"""Maritime customs analytics on Spark: arrival tracking and entry summary declarations."""
