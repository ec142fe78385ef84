"""Page-layout and localisation corpus analytics on Spark."""
