"""Product analytics on Spark: funnels, retention, growth, delivery and A/B readouts.

Every operator takes DataFrames and returns a lazy DataFrame.
"""
