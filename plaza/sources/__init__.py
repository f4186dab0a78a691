"""plaza.sources"""
