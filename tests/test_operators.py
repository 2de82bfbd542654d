"""Operators on small random tensors against numpy."""

import numpy as np
import pytest

from axisframe.operators import broadcast as B
from axisframe.operators import contract as C
from axisframe.operators import index as I
from axisframe.operators import losses as L
from axisframe.operators import reduce as R
from axisframe.operators import reshape as S
from axisframe.operators import split as P
from axisframe.operators import window as W
from axisframe.sources.build import *  # noqa: F403
from axisframe.sources.build import array_literal


@pytest.fixture(scope="module")
def checks(spark):
    """Each check's name with the tensor and the array that it should equal."""
    rng = np.random.default_rng(0)
    found = {}

    def T(a, dims=None):
        return array_literal(spark, np.asarray(a, float).tolist(), dims)

    def ok(name, got, want):
        found[name] = (got() if callable(got) else got), np.asarray(want, float)

    a=rng.integers(0,9,(3,4)).astype(float)
    b=rng.integers(1,9,(4,2)).astype(float)
    v=rng.normal(size=6)
    x3=rng.normal(size=(2,3,4))
    A=T(a,["i","j"])
    Bm=T(b,["j","k"])
    V=T(v,["i"])
    X=T(x3,["b","i","j"])
    ok("matmul",lambda:C.matmul(A,Bm),a@b)
    ok("einsum",lambda:C.einsum("ij,jk->ki",A,Bm),(a@b).T)
    ok("einsum3",lambda:C.einsum("bij,jk,kl->bil",X,Bm,T(b.T,["k","l"])),np.einsum("bij,jk,kl->bil",x3,b,b.T))
    ok("kron",lambda:C.kron(A,T(b,["p","q"])),np.kron(a,b))
    ok("multi",lambda:C.multi_dot([A,Bm,T(b.T,["k","l"])]),a@b@b.T)
    ok("power",lambda:C.matrix_power(T(a[:3,:3],["i","j"]),5),np.linalg.matrix_power(a[:3,:3],5))
    ok("cross",lambda:C.cross(T(a[:, :3],["i","j"]),T(a[:, 1:],["i","j"])),np.cross(a[:,:3],a[:,1:]))
    ok("outer",lambda:C.outer(V,T(v,["i"])),np.outer(v,v))
    ok("tensordot",lambda:C.tensordot(X,T(x3,["p","q","r"]),["i","j"],["q","r"]),np.tensordot(x3,x3,[[1,2],[1,2]]))
    ok("bmm",lambda:C.bmm(X,T(x3.transpose(0,2,1),["b","j","k"])),x3@x3.transpose(0,2,1))
    ok("linear",lambda:C.linear(A,T(b.T,["o","j"]),T([1,2],["o"])),a@b+np.array([1,2]))
    ok("bilinear",lambda:C.bilinear(A,T(x3[:, :, :].transpose(0,2,1),["o","p","q"]),T(a[:,:3],["i","q"])),np.einsum("ip,opq,iq->io",a,x3.transpose(0,2,1),a[:,:3]))
    q,k,vv=rng.normal(size=(3,4)),rng.normal(size=(5,4)),rng.normal(size=(5,2))
    s=np.exp(q@k.T/2)
    ok("attention",lambda:C.attention(T(q,["q","d"]),T(k,["s","d"]),T(vv,["s","o"])),(s/s.sum(1,keepdims=True))@vv)
    for h,f in (("sum",np.sum),("mean",np.mean),("max",np.max),("min",np.min),("prod",np.prod),("std",np.std),("var",np.var),("median",np.median),("ptp",np.ptp)): ok(h,lambda:R.reduce(X,h,["i"]),f(x3,axis=1)); ok(h+"0",lambda:R.reduce(X,h),f(x3))
    ok("keep",lambda:R.reduce(X,"sum",1,True),x3.sum(1,keepdims=True))
    ok("argmax",lambda:R.arg(X,"max","j"),x3.argmax(2))
    ok("quant",lambda:R.quantile(X,[.25,.9],"j"),np.quantile(x3,[.25,.9],axis=2))
    ok("lse",lambda:R.logsumexp(X,"j"),np.log(np.exp(x3).sum(2)))
    ok("norm3",lambda:R.norm(X,3,"j"),(np.abs(x3)**3).sum(2)**(1/3))
    ok("unique",lambda:R.unique(A),np.unique(a))
    ok("bincount",lambda:R.bincount(A),np.bincount(a.astype(int).ravel()))
    ok("hist",lambda:R.histogram(V,4)[0],np.histogram(v,4)[0])
    ok("kth",lambda:R.kth_value(X,2,"j")[0],np.sort(x3,2)[:,:,1])
    ok("lmed",lambda:R.lower_median(X,"j")[0],np.sort(x3,2)[:,:,1])
    ok("mode",lambda:R.mode(A,"j")[0],[max(sorted(set(r)),key=lambda z:(list(r).count(z),-z)) for r in a])
    ok("reshape",lambda:S.reshape(X,{"p":4,"q":-1}),x3.reshape(4,-1))
    ok("flatten",lambda:S.flatten(X,1),x3.reshape(2,-1))
    ok("T",lambda:S.transpose(X),x3.T)
    ok("moveaxis",lambda:S.moveaxis(X,0,-1),np.moveaxis(x3,0,-1))
    ok("roll",lambda:S.roll(X,3),np.roll(x3,3))
    ok("roll1",lambda:S.roll(X,1,"j"),np.roll(x3,1,2))
    ok("rollaxis",lambda:S.rollaxis(X,2,1),np.rollaxis(x3,2,1))
    for k_ in range(4): ok(f"rot{k_}",lambda:S.rot90(A,k_),np.rot90(a,k_))
    for m in ("constant","edge","reflect","symmetric","wrap"): ok("pad"+m,lambda:S.pad(A,{"i":(1,2),"j":(2,1)},m),np.pad(a,((1,2),(2,1)),m))
    ok("tile",lambda:S.tile(A,{"i":2,"j":3}),np.tile(a,(2,3)))
    ok("repeat",lambda:S.repeat(A,2,"j"),np.repeat(a,2,1))
    ok("repeatc",lambda:S.repeat(A,T([1,0,3],["i"]),"i"),np.repeat(a,[1,0,3],0))
    ok("insert",lambda:S.insert(A,1,T(a[:1],["i","j"]),"i"),np.insert(a,1,a[0],0))
    ok("delete",lambda:S.delete(A,[1,-1],"j"),np.delete(a,[1,-1],1))
    ok("resize",lambda:S.resize(A,{"p":5,"q":4}),np.resize(a,(5,4)))
    ok("rearr",lambda:S.rearrange(X,"b i (h w) -> (b h) w i",h=2),x3.reshape(2,3,2,2).transpose(0,2,3,1).reshape(4,2,3))
    ok("einred",lambda:S.einops_reduce(X,"b i j -> i","mean"),x3.mean((0,2)))
    ok("einrep",lambda:S.einops_repeat(A,"i j -> i (c j)",c=2),np.tile(a,(1,2)))
    px=rng.normal(size=(8,2,3))
    ok("pixsh",lambda:S.pixel_unshuffle(S.pixel_shuffle(T(px,["c","h","w"]),2),2),px)
    ok("interp",lambda:S.interpolate(A,{"i":5,"j":2}),a[np.floor(np.arange(5)*3/5).astype(int)][:,np.floor(np.arange(2)*4/2).astype(int)])
    ok("getitem",lambda:I.getitem(X,slice(None),-1,slice(3,0,-2)),x3[:,-1,3:0:-2])
    ok("getnew",lambda:I.getitem(X,None,Ellipsis,[2,0]),x3[None,...,[2,0]])
    ok("take",lambda:I.take(X,T([[0,2],[1,1]],["p","q"]),"i"),np.take(x3,[[0,2],[1,1]],1))
    ok("takealong",lambda:I.take_along(A,T([[0,3],[1,1],[2,0]],["i","j"]),"j"),np.take_along_axis(a,np.array([[0,3],[1,1],[2,0]]),1))
    ok("onehot",lambda:I.one_hot(T([0,2,1],["i"]),3),np.eye(3)[[0,2,1]])
    ok("dus",lambda:I.dynamic_update_slice(A,T([[7,7]],["i","j"]),{"i":5,"j":1}),(lambda z:(z.__setitem__((2,slice(1,3)),7),z)[1])(a.copy()))
    ok("concat",lambda:P.concatenate([A,A],1),np.concatenate([a,a],1))
    ok("stack",lambda:P.stack([A,A],1),np.stack([a,a],1))
    ok("split",lambda:P.split(A,2,1)[1],a[:,2:])
    ok("asplit",lambda:P.array_split(V,4)[2],np.array_split(v,4)[2])
    ok("chunk",lambda:P.chunk(V,4)[2],v[4:6])
    ok("blockd",lambda:P.block_diag(A,A),np.block([[a,np.zeros((3,4))],[np.zeros((3,4)),a]]))
    ok("dstack",lambda:P.dstack([V,V]),np.dstack([v,v]))
    pk,sh=P.pack([X,A.rename(i="z")],["j"])
    ok("pack",lambda:pk,np.concatenate([x3.reshape(6,4),a]))
    ok("unpack",lambda:P.unpack(pk,sh)[0],x3)
    ok("cumsum",lambda:W.cumsum(V),np.cumsum(v))
    ok("cumprod",lambda:W.cumprod(X,"i"),np.cumprod(x3,1))
    ok("sort",lambda:W.sort(V),np.sort(v))
    ok("argsort",lambda:W.argsort(X,"j"),np.argsort(x3,2))
    ok("softmax",lambda:W.softmax(X,"j"),np.exp(x3)/np.exp(x3).sum(2,keepdims=True))
    ok("topk",lambda:W.top_k(X,2,"j")[0],-np.sort(-x3,2)[:,:,:2])
    ok("pool",lambda:W.pool(X,2,spatial=1),x3.reshape(2,3,2,2).max(3))
    ok("unfold",lambda:W.unfold(V,"i",3,2),np.stack([v[0:3],v[2:5]]))
    ok("adapt",lambda:W.adaptive_pool(V,{"i":4}),[v[0:2].mean(),v[1:3].mean(),v[3:5].mean(),v[4:6].mean()])
    img=rng.normal(size=(2,5,5))
    ker=rng.normal(size=(3,2,3,3))
    ref=np.stack([sum(np.stack([[ (img[c,i:i+3,j:j+3]*ker[o,c]).sum() for j in range(3)] for i in range(3)]) for c in range(2)) for o in range(3)])
    ok("conv",lambda:W.convolve(T(img,["c","h","w"]),T(ker,["o","c","p","q"])),ref)
    ok("im2col",lambda:R.reduce(W.im2col(T(img,["c","h","w"]),(3,3)),"sum","patch"),[img[:,i:i+3,j:j+3].sum() for i in range(3) for j in range(3)])
    ct=np.zeros((3,6))
    xx=rng.normal(size=(2,3))
    kk=rng.normal(size=(2,3,2))
    for c in range(2):
        for o in range(3):
            for i in range(3):
                for d in range(2): ct[o,2*i+d]+=xx[c,i]*kk[c,o,d]
    ok("convT",lambda:W.convolve_transposed(T(xx,["c","n"]),T(kk,["c","o","k"]),stride=2),ct)
    ok("where",lambda:B.where(T(a>4,["i","j"]),A,0),np.where(a>4,a,0))
    ok("clip",lambda:B.clip(A,2,5),np.clip(a,2,5))
    ok("msel",lambda:B.masked_select(A,T(a>4,["i","j"])),a[a>4])
    ok("glu",lambda:B.glu(A),a[:,:2]/(1+np.exp(-a[:,2:])))
    ok("bcast",lambda:B.broadcast_to(V,{"p":2,"i":6}),np.broadcast_to(v,(2,6)))
    ok("addpos",lambda:B.binary(A,T([1,2,3,4],["z"]),"add",positional=True),a+[1,2,3,4])
    ok("select",lambda:B.select([T(a>6,["i","j"]),T(a>3,["i","j"])],[A,1],-1),np.select([a>6,a>3],[a,1],-1))
    ok("diag",lambda:diag(V,1),np.diag(v,1))
    ok("diag2",lambda:diagonal(A,1),np.diagonal(a,1))
    ok("trace",lambda:trace(A),np.trace(a))
    ok("circ",lambda:circulant(T([1,2,3],["i"])),[[1,3,2],[2,1,3],[3,2,1]])
    ok("convm",lambda:C.matmul(convolution_matrix(T([1,2,3],["i"]),4,"full"),T([1,0,2,1],["j"])),np.convolve([1,2,3],[1,0,2,1]))
    ok("convs",lambda:C.matmul(convolution_matrix(T([1,2,3],["i"]),4,"same"),T([1,0,2,1],["j"])),np.convolve([1,2,3],[1,0,2,1],"same"))
    ok("lin",lambda:linspace(spark,0,1,5),np.linspace(0,1,5))
    ok("geom",lambda:geomspace(spark,1,16,5),np.geomspace(1,16,5))
    ok("tri",lambda:tri(spark,3,4,1),np.tri(3,4,1))
    ok("mesh",lambda:meshgrid(T([1,2,3],["x"]),T([4,5],["y"]))[0],np.meshgrid([1,2,3],[4,5])[0])
    ok("idx",lambda:indices(spark,{"p":2,"q":3}),np.indices((2,3)))
    ok("eye",lambda:eye(spark,3,4,1),np.eye(3,4,1))
    ok("arange",lambda:arange(spark,1,8,2.5),np.arange(1,8,2.5))
    z=rng.normal(size=(4,3))
    y=np.array([0,2,1,1])
    lp=z-np.log(np.exp(z).sum(1,keepdims=True))
    ok("ce",lambda:L.cross_entropy(T(z,["n","c"]),T(y,["n"])),-lp[np.arange(4),y].mean())
    ok("huber",lambda:L.loss("huber",A,T(a.T.reshape(3,4),["i","j"])),np.where(abs(a-a.T.reshape(3,4))<=1,.5*(a-a.T.reshape(3,4))**2,abs(a-a.T.reshape(3,4))-.5).mean())
    ok("layern",lambda:W.normalise(X,"j"),(x3-x3.mean(2,keepdims=True))/np.sqrt(x3.var(2,keepdims=True)+1e-5))
    ok("scatter",lambda:I.scatter(A,T([[1,1],[2,2]],["i","j"]),"add"),(lambda z:(z.__setitem__((slice(0,2),slice(0,2)),z[:2,:2]+[[1,1],[2,2]]),z)[1])(a.copy()))
    ok("multin",lambda:R.reduce(sample_multinomial(T([[.2,.8],[.5,.5]],["r","c"]),50),"sum","c"),[50,50])
    return found


def cells(t):
    out = np.full(t.measured, np.nan if t.fill is None else t.fill)
    for r in t.df.collect():
        out[tuple(int(r[d]) for d in t.dims)] = r["value"]
    return out


def test_every_operator_equals_numpy(checks):
    wrong = []
    for name, (got, want) in checks.items():
        have = cells(got)
        if have.shape != want.shape or not np.allclose(have, want, equal_nan=True):
            wrong.append(name)
    assert not wrong
    assert len(checks) > 100
